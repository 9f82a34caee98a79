"""Each operator against a plain version, over rows with every oddity at once, and over an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidegauge.llm import components, exact_dedup, language_id, mixing, ngram_join, packing, quality, sanitise, sharding, substring_dedup, token_counts

from .conftest import odd_rows

ROWS = odd_rows()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def bag(rows):
    return Counter(tuple(r) for r in rows)


# exact dedup


def test_exact_dedup(odd):
    groups = defaultdict(list)
    for r in ROWS:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == best and left == 1
            left -= kept
            want[(i, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest())] += 1
    got = bag(exact_dedup.exact_dedup_report(odd).collect())
    assert got == want
    full = exact_dedup.exact_dedup_report(odd, max_filter_bytes=1)  # a filter at its bound flags more and changes nothing
    assert bag(full.collect()) == want


def test_exact_dedup_keeps_columns(odd):
    out = exact_dedup.exact_dedup(odd)
    assert out.columns == odd.columns
    assert Counter((r.text or "").translate(LOWER) for r in out.collect()) == Counter({(r[1] or "").translate(LOWER) for r in ROWS})


# near duplicates


def shingle_sets():
    out = []
    for r in ROWS:
        w = WORD.findall((r[1] or "").translate(LOWER))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def reachable():
    sets, n = shingle_sets(), len(ROWS)
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return sets, label


def test_ngram_join(odd):
    sets, label = reachable()
    least = {}
    for r, k in zip(ROWS, label):
        least[k] = min((x for x in (least.get(k), r[0]) if x is not None), default=None)
    want = Counter((r[0], len(s), least[k] if s else r[0]) for r, s, k in zip(ROWS, sets, label))
    assert bag(ngram_join.jaccard_components(odd).collect()) == want


@pytest.mark.parametrize("dealt_from", [3, 1 << 17])
def test_ngram_join_in_blocks(spark, dealt_from):
    """Tiles of many blocks, and tiles dealt over tasks, of which components join only some rows."""
    rng = random.Random(3)
    common = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):
        words = common[:]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(30)}"
        texts.append(" ".join(words[: rng.randint(20, 60)]))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    link = [(a, b) for a in range(150) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = list(range(150))
    for a, b in link:
        low, high = sorted((label[a], label[b]))
        label = [low if v == high else v for v in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = ngram_join.jaccard_components(docs, tile_rows=4, dealt_from=dealt_from)
    assert bag(got.collect()) == Counter((i, len(s), label[i]) for i, s in enumerate(sets)) and len(set(label)) > 5
    rows, pairs = ngram_join.jaccard_links(docs, tile_rows=4, dealt_from=dealt_from)
    assert pairs.count() == len({frozenset((sets[a], sets[b])) for a, b in link if sets[a] != sets[b]})
    assert {r.doc_id: r.n_links for r in rows.collect()} == {i: sum(i in p for p in link) for i in range(150)}


def test_near_dedup_keeps_one(odd):
    out = ngram_join.near_dedup(odd)
    assert out.columns == odd.columns
    sets, label = reachable()
    n = len({k for k, s in zip(label, sets) if s}) + sum(not s for s in sets)
    rows = out.collect()
    assert len(rows) == n and sum(1 for r in rows if (r.text or "").lower() == ROWS[0][1]) == 1


def test_shingles_by_segment(monkeypatch):
    raw = np.frombuffer(" ".join(r[1] or "" for r in ROWS).encode(), np.uint8)
    whole = ngram_join.word_hashes(raw)
    monkeypatch.setattr(ngram_join, "SEGMENT", 1000)
    assert (ngram_join.word_hashes(raw) == whole).all() and len(whole) == len(WORD.findall(raw.tobytes().decode()))


def test_overlap_bound_holds():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = np.unique(rng.integers(0, 4000, rng.integers(1, 900)).astype(np.uint64)), np.unique(rng.integers(0, 4000, rng.integers(1, 900)).astype(np.uint64))
        assert ngram_join.overlap_bound(ngram_join.bitmap(a), ngram_join.bitmap(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def test_links(odd):
    sets = shingle_sets()
    n = Counter()
    for a in range(len(ROWS)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
    rows, pairs = ngram_join.jaccard_links(odd)
    rows = rows.collect()
    assert bag((r.doc_id, r.n_shingles, r.n_links) for r in rows) == Counter((r[0], len(s), n[i]) for i, (r, s) in enumerate(zip(ROWS, sets)))
    of = {r.class_id: r.n_shingles for r in rows}
    classes = {s for s in sets if s}
    want = sum(100 * len(a & b) >= 80 * len(a | b) for a in classes for b in classes if a is not b) // 2
    assert len(of.keys() - {None}) == len(classes) and pairs.count() == want and all(r.class_a in of and r.class_b in of for r in pairs.collect())


# substring dedup


def spans_by(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.doc_id, r.row].update(range(r.start, r.end))
    return out


@pytest.mark.parametrize("max_filter_bytes", [64 << 20, 1])
def test_passages_against_all_chunks(spark, max_filter_bytes):
    rng = np.random.default_rng(11)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    shared = [letters(int(n)) for n in rng.integers(100, 900, 12)]
    texts = ["".join(x for k in rng.permutation(12)[: rng.integers(0, 4)] for x in (letters(int(rng.integers(20, 400))), shared[k])) + letters(50) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(7)
    rows = substring_dedup.repeated_passages(docs, max_filter_bytes=max_filter_bytes).collect()
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows) and len(rows) > 50
    for r in rows:  # the passage as a whole stands in the document named, and before it if that is its own
        body, kept = texts[r.doc_id].encode()[r.start : r.end], texts[r.first_doc_id].encode()
        assert len(body) >= substring_dedup.MIN_BYTES and r.first_doc_id <= r.doc_id
        assert body in (kept if r.first_doc_id < r.doc_id else kept[: r.end - 1])
    # every chunk that an earlier text has too, in a passage of at least 360 bytes that both share, is found
    found = spans_by(rows)
    for i, t in enumerate(texts):
        for k, p in enumerate(shared):
            at = t.find(p)
            if at >= 0 and len(p) >= 360 and any(p in x for x in texts[:i]):
                covered = {x for (d, _), own in found.items() if d == i for x in own}
                assert len(covered & set(range(at, at + len(p)))) >= len(p) - 250


def test_passages_of_odd_rows(odd):
    rows = substring_dedup.repeated_passages(odd).collect()
    texts = defaultdict(list)
    for r in ROWS:
        texts[r[0]].append((r[1] or "").encode())
    for r in rows:
        assert any(t[r.start : r.end] in k for t in texts[r.doc_id] if len(t) >= r.end for k in texts[r.first_doc_id]), r
    long = [r for r in rows if r.doc_id in (13, 14)]
    assert long and all(r.first_doc_id == r.doc_id for r in long)  # periodic texts repeat themselves


def test_passages(odd):
    rows = substring_dedup.repeated_passages(odd).collect()
    text = {r[0]: r[1] for r in ROWS}
    assert 11 in {r.doc_id for r in rows} and 10 not in {r.doc_id for r in rows} and {2, 4} <= {r.doc_id for r in rows}
    for r in rows:
        if r.doc_id == 11:
            assert text[11].encode()[r.start : r.end] in text[10].encode() and r.first_doc_id == 10


def test_dedup_substrings(odd):
    out = substring_dedup.dedup_substrings(odd)
    assert out.columns == odd.columns and out.count() == len(ROWS)
    rows = {r.doc_id: r.text for r in out.collect()}
    text = {r[0]: r[1] for r in ROWS}
    assert rows[10] == text[10] and len(rows[11]) < len(text[11]) - 200 and rows[5] is None and rows[6] == ""


def test_chunks_resist_shifts():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 123, 20000).astype(np.uint8)
    ends = substring_dedup.chunk_ends(raw)
    moved = substring_dedup.chunk_ends(np.concatenate([rng.integers(97, 123, 77).astype(np.uint8), raw])) - 77
    assert ends[-1] == len(raw) and len(set(ends) & set(moved)) > 0.97 * len(ends)
    long = np.frombuffer(("é" * 3000).encode(), np.uint8)
    assert (np.diff(substring_dedup.chunk_ends(long), prepend=0) <= substring_dedup.MAX_CHUNK).all()


# mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.targets([10, 100, 100], [5, 2, 1])
    assert got[0] == 30.0 and sum(got) == pytest.approx(210) and got[1] == pytest.approx(2 * got[2])
    assert mixing.targets([0, 5], [5, 2]) == [0.0, 5.0] and mixing.targets([], []) == []


def plain_targets(size: dict, weight: dict) -> dict:
    """Share by weight, hold what is above three times its size there, and begin again with the rest."""
    held: dict = {}
    while True:
        free = [s for s in size if s not in held]
        rest = sum(size.values()) - sum(held.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3.0 * size[s] for s in free if share[s] > 3 * size[s]}
        if not over:
            return held | share
        held |= over


def test_targets_of_each_document(odd):
    size = Counter()
    for r in ROWS:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = plain_targets(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for r in mixing.mix(odd).collect():
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])


def test_mixed_shares_copies_of_equal_rows(spark):
    rows = [(None, "same words here", "a", k % 3) for k in range(500)] + [(i, f"own words {i}", "a", 0) for i in range(500)] + [(i, "x " * 40, "b", 0) for i in range(500, 540)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, more int").repartition(6)
    drawn = mixing.mix(docs, block_rows=100).collect()
    want = sum(r.copies for r in drawn if r.doc_id is None)
    out = mixing.mixed(docs, block_rows=100).collect()
    own = Counter(r.more for r in out if r.doc_id is None)
    assert sum(own.values()) == want and len(out) == sum(r.copies for r in drawn) and max(own.values()) <= 2 * 167
    blocks = Counter(r.copies for r in drawn if r.doc_id is None)
    assert len(blocks) >= 1 and sum(blocks.values()) == 500


@pytest.mark.parametrize("block_rows", [20_000, 12])
def test_mix(odd, block_rows):
    rows = mixing.mix(odd, block_rows=block_rows).collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in ROWS}
    assert bag((r.doc_id, r.size) for r in rows if r.doc_id is not None) == Counter((r[0], size[r[0]]) for r in ROWS if r[0] is not None)
    total, by = sum(r.size for r in rows), defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert sum(x[0].target for x in by.values()) == pytest.approx(total)
    for own in by.values():
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= max(5, 0.02 * own[0].target, 0.5 * max(r.size for r in own if r.size > 1000) if any(r.size > 10_000 for r in own) else 0)
        assert all(0 <= r.copies <= 3 for r in own)
    again = mixing.mix(odd.repartition(3), block_rows=block_rows)
    assert bag((r.doc_id, r.h, r.copies) for r in again.collect()) == bag((r.doc_id, r.h, r.copies) for r in rows)


def test_flight_keeps_totals():
    rng = np.random.default_rng(5)
    size = rng.integers(0, 500, 2000).astype(float).tolist()
    p = [0.37] * 2000
    mixing.fly(p, size, rng.random, 2)
    assert sum(0 < x < 1 for x in p) <= 2 and sum(p) == pytest.approx(740) and np.dot(p, size) == pytest.approx(0.37 * sum(size))


def test_inclusion_is_unbiased():
    rng = np.random.default_rng(9)
    hits = np.zeros(30)
    for _ in range(1500):
        p = [0.3] * 30
        mixing.fly(p, [float(1 + i % 7) for i in range(30)], rng.random, 2)
        hits += p
    assert np.abs(hits / 1500 - 0.3).max() < 0.06


def test_mixed_repeats_documents(odd):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    want = Counter()
    for r in mixing.mix(odd).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want


# packing


def test_word_ids_are_the_tokenizer_s():
    """Words of letters and marks take a shorter way, unless a letter's lower case would join the marks."""
    from tokenizers import Tokenizer

    with open(VOCABULARY, "rb") as f:
        told = f.read()
    texts = ["Word, word... caf\u00e9$$$ it's x'll abc'! \u00c9t\u00e9?! na\u00efve### 12ab. ab12, <|endoftext|>. \u017fo; \u01c5a! \u03a3\u03a3. caf\u0065\u0301. a_b_ \u00aa\u00ba)", "XYa\u0130. \u0130>{ a\u0130b!", "a=\u0338 ... ,"]
    tokenizer = Tokenizer.from_str(told.decode())
    assert [np.frombuffer(x, "<u4").tolist() for _, x in packing.document_ids(pa.array(texts), told)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert packing.WordIds(told).lean is not None


def test_packing(odd):
    tok = Tokenizer.from_file(VOCABULARY)
    ids = defaultdict(list)
    for r in ROWS:
        ids[r[0]].append([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0])
    rows = packing.pack_documents(odd, VOCABULARY, bucket_rows=16).collect()
    want = Counter((i, k // 2048, k, len(x[k : k + 2048]), zlib.crc32(np.array(x[k : k + 2048], "<u4").tobytes())) for i, xs in ids.items() for x in xs for k in range(0, len(x), 2048))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_sequences_round_trip(odd):
    made = [np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequence_tokens(odd, VOCABULARY, bucket_rows=16).collect()]
    tok = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for r in ROWS:  # nulls and rows that repeat others too
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.update(tuple(ids[k : k + 2048]) for k in range(0, len(ids), 2048))
    whole = [p for p in want if p[-1] != 0]  # all but the last piece of a document end without 0
    got = Counter()
    for x in made:
        assert len(x) <= 2048
        if tuple(x.tolist()) in whole:
            got[tuple(x.tolist())] += 1
        else:
            cut = [0, *(np.flatnonzero(x == 0) + 1).tolist()]
            assert cut[-1] == len(x)
            got.update(tuple(x[a:b].tolist()) for a, b in zip(cut, cut[1:]))
    assert got == want


def test_sequences_of_the_mix(odd):
    docs = mixing.mixed(odd)
    layout = packing.pack_documents(docs, VOCABULARY)
    made = [len(bytes(r.ids)) // 4 for r in packing.sequence_tokens(docs, VOCABULARY).collect()]
    assert sum(made) == sum(r.length for r in layout.collect()) and max(made) <= 2048


def test_plan_uses_all_and_fills():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(1, 101, 5000), minlength=101)
    made = packing.plan(counts, 100)
    used = Counter()
    for content, times in made:
        assert sum(content) <= 100
        for x in content:
            used[x] += times
    assert used == Counter({x: int(n) for x, n in enumerate(counts) if n})
    assert sum(t for _, t in made) <= 1.005 * (counts * np.arange(101)).sum() / 100 + 1


def test_exact_fill_against_all():
    rng = np.random.default_rng(4)
    for _ in range(300):
        left = rng.integers(0, 4, 31) * (rng.random(31) < 0.3)
        left[0] = 0
        gap = int(rng.integers(1, 31))
        items = [x for x in range(31) for _ in range(left[x])]
        possible = any(sum(c) == gap for k in (1, 2, 3) for c in __import__("itertools").combinations(items, k))
        got = packing.exact_fill(gap, left)
        if got:
            assert sum(got) == gap and all(left[x] >= n for x, n in Counter(got).items())
        assert bool(got) == possible


# token counts


def naive(word: str, vocabulary: set[str]) -> int:
    at, n = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if (word[at:e] + "</w>" in vocabulary if e == len(word) else False) or word[at:e] in vocabulary), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_token_counts(odd):
    letters = {b: c for c, b in token_counts.byte_letters().items()}
    pieces = token_counts.file_vocabulary(VOCABULARY)
    known = set(pieces)
    rows = token_counts.token_counts(odd, pieces).collect()
    memo = {}
    want = Counter()
    for r in ROWS:
        words = WORD.findall(r[1] or "")
        if max(map(len, words), default=0) > 5000:
            words, skip = [], True
        else:
            skip = False
        for w in set(words):
            memo.setdefault(w, naive("".join(letters[b] for b in w.lower().encode()), known))
        if not skip:
            want[(r[0], len(words), sum(memo[w] for w in words))] += 1
    got = bag((r.doc_id, r.n_words, r.n_tokens) for r in rows)
    assert not want - got and sum(got.values()) == len(ROWS)


def test_continuation_pieces():
    a = token_counts.of_continuations(["un", "##aff", "##able", "##a", "##ff", "a", "b"])
    assert [a.count(w) for w in (b"unaffable", b"unaff", b"a", b"aff", b"x", b"unx", b"abz")] == [3, 2, 1, 2, 1, 1, 1]


def test_per_word(spark):
    df = spark.createDataFrame([(1, "the  theth"), (2, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in token_counts.token_counts(df, token_counts.file_vocabulary(VOCABULARY), per_word=True).collect()}
    assert len(rows[1].word_tokens) == 2 and sum(rows[1].word_tokens) == rows[1].n_tokens and list(rows[2].word_tokens) == []


# language ID


def test_language_id(spark, odd):
    en = ["the of and to in is that it was for on with as are this by from at or have"] * 3
    fr = ["le la les des une et est dans que pour qui sur avec pas au du ce il elle nous"] * 3
    ru = ["и в не на я быть он с что а по это она этот к но они мы весь"] * 3
    rows = [(i, f"{t} {i}", g) for i, (t, g) in enumerate([(x, "en") for x in en * 20] + [(x, "fr") for x in fr * 20] + [(x, "ru") for x in ru * 20])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(docs)
    found = {r.c0: (r.lang_pred, r.score) for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    assert all(found[i][0] == g and 0 <= found[i][1] <= 1 for i, _, g in rows)
    mixed = spark.createDataFrame([(1, en[0] + " " + fr[0] + " " + ru[0])], "doc_id bigint, text string")
    spans = language_id.predict(mixed, model, ["doc_id"], spans=True).first().spans
    assert [s.lang for s in spans] == ["en", "fr", "ru"] and [s.end - s.start for s in spans] == [len(x.split()) for x in (en[0], fr[0], ru[0])]
    strange = {(r.c0, r.c1): r for r in language_id.predict(odd, model, ["doc_id", "text"]).collect()}
    assert strange[5, None].lang_pred == "und" and strange[16, "12345 678 !!! ???"].lang_pred == "und" and strange[6, ""].score == 0
    assert strange[15, "привет мир это текст на другом языке"].lang_pred == "ru"
    out = language_id.identified(odd)
    assert out.columns == odd.columns and not {5, 6, 7, 16} & {r.doc_id for r in out.collect()}


def test_language_id_keeps_mixed_texts(spark):
    en, fr, de = ("the of and to in is that it was for on with", "le la les des une et est dans que pour qui sur", "der die das und ist nicht ein eine mit auf den von")
    rows = [(i, f"{t} {i}", g) for i, (t, g) in enumerate([(en, "en"), (fr, "fr"), (de, "de")] * 30)]
    rows += [(900, f"{en} {fr} {de}", None), (901, "один два три четыре пять шесть семь", None), (902, f"{en} один два", None), (903, "12 !", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in language_id.identified(docs).collect()} == {*range(90), 900, 902}


def plain_model(rows):
    """Counts of scripts and trigrams by language, of labelled rows outside the held-out third."""
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            for word in (text or "").split():
                letters = "".join(c for c in word if c.isalpha()).lower()
                padded = "^^" + letters + "$"
                if letters:
                    counts[lang].update(padded[k : k + 3] for k in range(len(padded) - 2))
                    counts[lang].update("@" + language_id.script_of(c) for c in letters)
    return language_id.Model([(lang, g, n) for lang, own in counts.items() for g, n in own.items()])


def plain_label(model, text):
    """The best path over a text's words, one word after the other."""
    n = len(model.languages)
    best, paths, weight = [0.0] * n, [[] for _ in range(n)], []
    for word in (text or "").split():
        score, letters, _ = model.words([word])
        weight.append(int(letters[0]))
        top = max(range(n), key=lambda x: best[x])
        moved = [(best[top] - language_id.SWITCH, top) if best[top] - language_id.SWITCH > best[x] else (best[x], x) for x in range(n)]
        best = [v + float(score[0][x]) for x, (v, _) in enumerate(moved)]
        paths = [[*paths[came], x] for x, (_, came) in enumerate(moved)]
    if not sum(weight):
        return "und", 0.0
    path = paths[max(range(n), key=lambda x: best[x])]
    share = [sum(w for w, y in zip(weight, path) if y == x) for x in range(n)]
    return model.languages[max(range(n), key=lambda x: share[x])], max(share) / sum(weight)


def test_predictions_against_a_plain_version(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [(10_000 + i, t, None) for i, t in enumerate((None, "", "12 34", "привет мир", "a" * 3000, "the " * 2000, "le la the der und"))]
    frame = spark.createDataFrame(docs + odd, "doc_id bigint, text string, lang string")
    model = plain_model(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(frame, language_id.train(frame), ["doc_id"]).withColumnRenamed("c0", "doc_id").collect()}
    for i, text, _ in docs + odd:
        want = plain_label(model, text)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1], abs=1e-3), (i, got[i], want)


def test_held_out_documents_are_not_learned_from(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in docs]
    changed = [(i, "zzz qqq " * 50, "xx") if o else (i, t, g) for (i, t, g), o in zip(docs, out)]
    a, b = (language_id.train(spark.createDataFrame(x, "doc_id bigint, text string, lang string")) for x in (docs, changed))
    assert a.languages == b.languages and "xx" not in b.languages and a.index == b.index and (a.table == b.table).all() and sum(out) > 20


def test_language_id_keeps_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "GRAMS", 20)
    rows = [(i, " ".join(a + b + c for a in "abcd" for b in "abcd" for c in "abcd"), "many") for i in range(30)] + [(i, "xyz zyx", "rare") for i in (101, 102, 103) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert rows[-1][2] == "rare" and set(language_id.train(docs).languages) == {"many", "rare"}
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language_id.train(docs)


def test_viterbi_against_all():
    rng = np.random.default_rng(6)
    import itertools

    for _ in range(20):
        score = rng.normal(size=(3, 6, 3)).astype(np.float32)
        label = language_id.viterbi(score, 1.0)
        for t in range(3):
            value = lambda path, t=t: sum(score[t, i, x] for i, x in enumerate(path)) - sum(a != b for a, b in zip(path, path[1:]))
            assert value(label[t]) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=6)), abs=1e-4)


# quality


def test_quality(odd):
    want = Counter()
    for r in ROWS:
        text = r[1] or ""
        w = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))] += 1
    rows = quality.quality_report(odd).collect()
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows) and all(0 <= r.character_distance <= 1 and 0 <= r.word_distance <= 1 for r in rows)


def test_divergence_drops_the_odd_one(spark):
    prose = "the cat and the dog went to the house of a man who was in it and the sun was on the hill as we ran by " * 3
    rows = [(i, " ".join(np.random.default_rng(i).permutation(prose.split())), "en") for i in range(40)] + [(99, " ".join(f"X{i}Q|" for i in range(80)), "en")]
    out = {r.doc_id: r.kept for r in quality.quality_report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert not out[99] and all(out[i] for i in range(40))


# sharding


@pytest.mark.parametrize("block_rows", [200_000, 2])
def test_sharding(odd, block_rows):
    rows = sharding.shard_rows(odd, block_rows=block_rows).collect()
    assert bag((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((x[0], len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode())) for x in ROWS)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(24))
    sizes = [len(by.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_matrix_law():
    blocks, shards = [5, 0, 9, 2], [4, 4, 4, 4]
    mean = np.zeros((4, 4))
    for seed in range(400):
        m = sharding.communication_matrix(blocks, shards, seed)
        assert m.sum(0).tolist() == shards and m.sum(1).tolist() == blocks and (m >= 0).all()
        mean += m / 400
    assert np.abs(mean - np.outer(blocks, shards) / 16).max() < 0.25


def test_write_shards(odd, tmp_path, spark):
    docs = odd.selectExpr("*", "lang AS shard", "source AS slot")  # null and repeated ids, equal rows, clashing names
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3, block_rows=7)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert bag(back.select(*docs.columns).collect()) == bag(docs.collect())
    sizes = [r["count"] for r in back.groupBy("shard_").count().collect()]
    assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1


def test_shuffle_is_uniform(spark):
    rows = spark.range(240).selectExpr("id AS doc_id", "'t' AS text").union(spark.range(60).selectExpr("CAST(NULL AS bigint) AS doc_id", "'same' AS text"))
    where = np.zeros((240, 4))
    for seed in range(12):
        found = sharding.shard_rows(rows, shards=4, seed=seed, block_rows=50).collect()
        for r in found:
            if r.doc_id is not None:
                where[r.doc_id, r.shard] += 1
        own = Counter(r.shard for r in found if r.doc_id is None)
        assert max(own.values()) < 40  # equal rows spread too
        assert sum(r.slot for r in found) == 4 * sum(range(75))
    chi = ((where - 3) ** 2 / 3).sum() / 240
    assert 2.4 < chi < 3.6  # three degrees of freedom a row


def test_shards_do_not_depend_on_partitions(odd):
    a, b = (bag(sharding.shard_rows(x, block_rows=9).collect()) for x in (odd, odd.repartition(2)))
    assert a == b


# personal data

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_of(text):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if holds(k, m.group())))


TRICKY = [
    "a@b.co_x@y.zz", "a@b@c.de", "..@x.y", "x@-.-", "a@b.c.", "é@x.com ü+q%w@sub.dom.example.org", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "00255.0.0.1", "1.2.3", "999.1.2.3.4",
    "4111-1111-1111-1111", "4111 1111  1111 1111", "4111111111111111 5500000000000004", "0000000000000", "+1 (555) 010-9999", "+123", "++49 30 1234567)", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "😀 a@b.cd 😀 10.20.30.40", "1 " * 30000, "a" * 100000, "9" * 50000, "ip 1.1.1.1, " * 300,
]


def test_findings(spark, odd):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    got = {r.doc_id: r.spans for r in sanitise.findings(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", sanitise.written(sanitise.F.col("base")).alias("spans")).collect()}
    for i, t in rows:
        assert got[i] == base_of(t), t[:80]
    for r in sanitise.findings(odd).select("doc_id", sanitise.written(sanitise.F.col("found")).alias("spans")).where("doc_id = 17").collect():
        assert r.spans == base_of(next(x[1] for x in ROWS if x[0] == 17))


def test_revealing_terms(spark):
    names = ["alder", "birch", "cedar", "maple"]
    rows = [(i, f"{'common words here today' if i % 2 else 'other common words'} {i} please ask zebulon at z.q@x.org about {names[i % 4]} soon") for i in range(6)]
    rows += [(100 + i, f"common words about {names[i % 4]} and please ask soon other here today {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.found for r in sanitise.findings(docs).collect()}
    assert {x.value for x in found[0] if x.kind == 4} == {"zebulon"} and not found[100]
    clean = {r.doc_id: r.text for r in sanitise.sanitise(docs).collect()}
    assert "zebulon" not in clean[3] and "[TERM] at [EMAIL] about" in clean[3] and clean[150] == rows[56][1]


def test_terms_of_rare_entities(spark):
    rows = [(1, "please ask zebulon soon at z.q@x.org about common words today"), (2, "please ask quentin soon at q.q@x.org about common words"), (3, "quentin at q.q@x.org today")]
    rows += [(100 + i, f"please ask soon about common words today {i}") for i in range(1000)]
    found = {r.doc_id: r.found for r in sanitise.findings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: {x.value for x in found[i] if x.kind == 4} for i in (1, 2, 3)} == {1: {"zebulon"}, 2: {"quentin"}, 3: {"quentin"}} and not found[150]


def test_terms_far_from_entities(spark):
    far = "please ask about common words today " * 30
    rows = [(i, f"{far}Zebulon {far}mail z.q@x.org {far}zebulon {far}{i}") for i in range(3)] + [(100 + i, f"mail {far}{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.found for r in sanitise.findings(docs).collect()}
    assert [(rows[1][1][x.start : x.end], x.value) for x in found[1] if x.kind == 4] == [("Zebulon", "zebulon"), ("zebulon", "zebulon")] and not found[150]


def plain_findings(rows):
    """Base and term spans of each text by the formula, from sets of whole documents."""
    term = re.compile(r"[^\W\d_]{3,}")
    base = [[(m.start(), i, m.end(), f"{i}:{m.group().lower()}") for i, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, t) if holds(k, m.group())] for _, t in rows]
    words = [{m.group().lower() for m in term.finditer(t)} for _, t in rows]
    n, n_t = len(rows), Counter(w for own in words for w in own)
    where = defaultdict(set)
    for d, own in enumerate(base):
        for *_, entity in own:
            where[entity].add(d)
    told = defaultdict(set)
    for docs in where.values():
        share = len(docs) / n
        for w in {w for d in docs for w in words[d]} if len(docs) < n else ():
            n_et = sum(w in words[d] for d in docs)
            p = (n_et + sanitise.PRIOR * share) / (n_t[w] + sanitise.PRIOR)
            if 1 - np.log(p) / np.log(share) >= sanitise.DISCLOSURE:
                for d in docs:
                    told[d].add(w)
    out = {}
    for d, (i, t) in enumerate(rows):
        spans = [x[:3] for x in base[d]]
        spans += [(m.start(), 4, m.end()) for m in term.finditer(t) if m.group().lower() in told[d] and not any(m.start() < e and m.end() > s for s, _, e, _ in base[d])]
        out[i] = ",".join(f"{(*sanitise.KINDS, 'term')[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return out


def test_disclosure_against_a_plain_version(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: r.spans for r in sanitise.findings(spark.createDataFrame(docs, "doc_id bigint, text string")).select("doc_id", sanitise.written(sanitise.F.col("found")).alias("spans")).collect()}
    assert got == plain_findings(docs) and sum("term:" in x for x in got.values()) > 10


def test_sharding_draws_beyond_the_generator():
    rng = np.random.default_rng(3)
    rare = np.array([sharding._large(rng, 1000, 2 * 10**9, 2 * 10**6) for _ in range(4000)])
    assert abs((rare == 0).mean() - np.exp(-1)) < 0.03 and abs((rare == 1).mean() - np.exp(-1)) < 0.03 and abs((rare == 2).mean() - np.exp(-1) / 2) < 0.03
    wide = np.array([sharding._large(rng, 10**9, 3 * 10**9, 200_000) for _ in range(4000)])
    assert abs(wide.mean() - 50_000) < 15 and abs(wide.std() / 37_498**0.5 - 1) < 0.05
    blocks, shards = [2_000_000, 1_998_001_000], [1000, 2_000_000_000]
    deal = sharding.communication_matrix(blocks, shards, 5)
    assert deal.sum(axis=1).tolist() == blocks and deal.sum(axis=0).tolist() == shards and (deal >= 0).all()


# empty tables


def test_empty_tables(none):
    assert exact_dedup.exact_dedup_report(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0
    assert ngram_join.jaccard_components(none).count() == 0 and ngram_join.near_dedup(none).count() == 0
    assert substring_dedup.repeated_passages(none).count() == 0 and substring_dedup.dedup_substrings(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert packing.pack_documents(none, VOCABULARY).count() == 0
    assert token_counts.token_counts(none, ["a"]).count() == 0
    assert language_id.identified(none).count() == 0
    assert quality.quality_report(none).count() == 0 and sharding.shard_rows(none).count() == 0
    assert sanitise.findings(none).count() == 0 and sanitise.sanitise(none).count() == 0
