import random

import pytest

#: Names that operators use inside, as columns of the caller.
CLASHING = {"h": 1, "uid": 2, "row": 3, "c0": 4, "size": 5, "n": 6, "block": 7, "key": 8, "lang_pred": 9, "__id": 10, "rank": 11, "bucket": 12, "kept": 13, "p": 14}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{k}` int" for k in CLASHING)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows, near copies, shared passages, other scripts."""
    rng = random.Random(7)
    base, passage = sentence(rng, 120), sentence(rng, 60)
    words = base.split()
    near = " ".join([*words[:50], "changed", *words[51:]])
    texts = [
        (1, base), (2, base), (2, base), (3, base.upper()), (4, near), (5, None), (6, ""), (7, " \t\n "), (8, "one two three"), (9, "One two THREE"),
        (10, sentence(rng, 90) + " " + passage + " " + sentence(rng, 40)), (11, sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 80)),
        (None, base), (None, sentence(rng, 25)), (None, None), (12, "é" * 3000 + " ü ß"), (13, "a " * 40000), (14, "x" * 150000), (15, "привет мир это текст на другом языке"),
        (16, "12345 678 !!! ???"), (17, "write to ann.b@mail.example.com or +1 (555) 010-9999, 10.0.0.255, 4111 1111 1111 1111"), (18, sentence(rng, 3000)),
        (19, "a b c d"), (20, "line one here\nline one here\n\nline two"), (20, "line one here\nline one here\n\nline two"), (2**62, "tail"), (-5, "tail"),
    ]
    texts += [(100 + i, sentence(rng, rng.randint(1, 300))) for i in range(60)]
    langs, sources = ["en", "fr", None, "de"], ["a", "b", None, "z", "é"]
    return [(i, t, langs[k % 4], sources[k % 5], len(t or ""), *CLASHING.values()) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
