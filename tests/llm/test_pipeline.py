"""The pipeline's stages one after another, each against a plain version over its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline

from .conftest import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    return a and b and 100 * len(a & b) >= 80 * len(a | b)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages(spark, odd, tmp_path):
    docs, columns, seen = odd, odd.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert docs.columns == columns or name == "packing"
    given = Counter(r[:2] for r in odd_rows())
    first = Counter((r.doc_id, r.text) for r in seen["language_id"])
    assert first <= given and all(any(c.isalpha() for c in t or "") for _, t in first)
    second = [r.text.translate(LOWER) for r in seen["exact_dedup"]]
    assert Counter(second) == Counter({t.translate(LOWER) for _, t in first})
    third = [shingles(r.text) for r in seen["ngram_join"]]
    assert not any(near(a, b) for i, a in enumerate(third) for b in third[:i])
    kept = {r.doc_id for r in seen["ngram_join"]}
    before = [(r.doc_id, shingles(r.text)) for r in seen["exact_dedup"]]
    assert {i for i, a in before if not any(near(a, b) for j, b in before if j != i)} <= kept
    mixed = Counter((r.doc_id, r.text) for r in seen["mixing"])
    assert set(mixed) <= {(r.doc_id, r.text) for r in seen["ngram_join"]} and max(mixed.values()) <= 3
    assert Counter(r.doc_id for r in seen["packing"] if r.piece == 0) == Counter(r.doc_id for r in seen["mixing"])


def test_run_on_an_empty_table(spark, none, tmp_path):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_takes_an_empty_table(spark, none, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, none, "").count() == 0
