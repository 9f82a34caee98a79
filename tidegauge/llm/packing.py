"""Best-fit packing by exact-complement hashing.

Texts become token ids, each document ends with id 0, and only documents beyond the capacity are cut. What
is packed are lengths: at most ``capacity`` distinct ones, so a histogram holds the whole problem whatever
the corpus. Starting from the largest length left, the gap is filled exactly by one, two or three lengths
whose sums are looked up under what is still available; where none fit exactly, the best fitting length
goes in and the search goes on with the rest. Each combination is used as often as the counts allow, so
plans are short. Pieces then find their place by their rank among pieces of equal length: ranks are taken in
buckets by hash, so one length may hold any share of the pieces.

Token ids come from the tokenizer, word by word: no token spans white space. What a worker remembers of
words is bounded.

Defined cases: a null text is empty and becomes the one id 0; rows that repeat others and null doc_ids are
packed like any row; very long texts become many pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import ready
from .shared import durable, memo, pick, text_array

CAPACITY = 2048
BUCKET_ROWS = 500_000
#: Words whose ids a worker remembers, and bytes of text for which it looks up words at once.
WORDS_HELD = 400_000
CHUNK = 1 << 20
#: Letters whose lower case may depend on those beside them, or be several.
BEYOND = re.compile("[\u0130\u0180-\U0010ffff]")
#: Marks that, behind letters, are one token's text apart from them; an apostrophe may begin a contraction.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def lean(told: dict):
    """The tokenizer of a file's text for words of lower-case letters below U+0180 only, parted by spaces: its steps before the model leave these as they are, so they are left out, and so is the model's cache of words. None for files with other steps."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    steps = [[x["type"] for x in (told[k] or {}).get(k + "s" if k == "normalizer" else "pretokenizers", [])] for k in ("normalizer", "pre_tokenizer")]
    model = told["model"]
    if steps != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or model["type"] != "BPE" or model["dropout"] or model.get("ignore_merges") or model["unk_token"] or model["byte_fallback"] or model["continuing_subword_prefix"] or not model["end_of_word_suffix"]:
        return None
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    made = Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"]))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


class WordIds:
    """Ids of words as little-endian 32-bit bytes, each word encoded once while remembered."""

    def __init__(self, told: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(told.decode())
        self.lean = lean(json.loads(told)) or self.tokenizer
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.of: dict[bytes, bytes] = {}
        self.plain: dict[str, bytes] = {"": b""}

    def encode(self, forms: list[str]) -> None:
        """Learn forms: those of letters only are one word of the tokenizer each, so many go through it as one text, and end marks part them again."""
        letters = [x for x in forms if x.isalpha()]
        beyond = {x for x in letters if BEYOND.search(x)} if BEYOND.search(" ".join(letters)) else set()
        for coder, words in ((self.lean, [x for x in letters if x not in beyond] if beyond else letters), (self.tokenizer, list(beyond))):
            for k in range(0, len(words), 4096):
                part = words[k : k + 4096]
                texts = [" ".join(part[i : i + 64]) for i in range(0, len(part), 64)]
                ids = np.array([x for e in coder.encode_batch_fast(texts, add_special_tokens=False) for x in e.ids], "<u4")
                cut = np.flatnonzero(self.ends[ids]) + 1
                if len(cut) == len(part):
                    data, at = ids.tobytes(), (4 * cut).tolist()
                    self.plain.update(zip(part, [data[x:y] for x, y in zip([0, *at], at)]))
        rest = [x for x in forms if x not in self.plain]
        for x, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.plain[x] = np.array(e.ids, "<u4").tobytes()

    def learn(self, words: list[list[bytes]]) -> None:
        every = set().union(*words)
        of = self.of
        new = list(every.difference(of))
        if len(of) + len(new) > WORDS_HELD:
            of.clear()
            self.plain = {"": b""}
            new = list(every)
        if not new:
            return
        forms = b"\n".join(new).decode()
        # letters before marks are tokens apart from them, and letters below U+0180 lower one by one
        low = forms.lower().split("\n")
        if not forms.isascii() and BEYOND.search(forms):
            low = [f if BEYOND.search(f) else x for x, f in zip(low, forms.split("\n"))]
        bodies = [x if x.isalpha() else b if (b := x.rstrip(MARKS)).isalpha() and "\u0130" not in b else x for x in low]  # that letter's lower case ends in a mark
        tails = {x[len(b) :] for x, b in zip(low, bodies) if len(x) != len(b)}
        plain = self.plain
        self.encode(list({x for x in (*bodies, *tails) if x not in plain}))
        of.update([(w, plain[b] if len(x) == len(b) else plain[b] + plain[x[len(b) :]]) for w, b, x in zip(new, bodies, low)])


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(row of the first text, words of some texts)."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts.cast(pa.binary())):
        held.append(text.as_py().split())
        size += sum(map(len, held[-1])) + 1
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def document_ids(texts: pa.Array, told: bytes) -> Iterator[tuple[int, bytes]]:
    """(row, ids with the closing 0) of each text of an array without nulls."""
    ids = memo(("packing", zlib.crc32(told)), lambda: WordIds(told))
    for first, held in _chunks(texts):
        ids.learn(held)
        get = ids.of.__getitem__
        for i, words in enumerate(held):
            yield first + i, b"".join(map(get, words)) + b"\0\0\0\0"


def _pieces(told, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in document_ids(text_array(batch.column(1)), told.value):
                for k in range(0, len(data), 4 * capacity):
                    part = data[k : k + 4 * capacity]
                    row.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(ids, pa.binary())] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit) of each piece. tokenizer: a file of the tokenizers library, read on the driver (its size is fixed)."""
    with open(tokenizer, "rb") as f:
        told = ready(docs).sparkContext.broadcast(f.read())
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(*pick(docs, doc_id, text)).toDF("doc_id", "text").mapInArrow(_pieces(told, capacity, with_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def exact_fill(gap: int, left: np.ndarray) -> list[int]:
    """One, two or three of the lengths left (left[length] of each) with sum gap, larger ones first; none: []."""
    if left[gap]:
        return [gap]
    there = left > 0

    def two(total: int, top: int) -> list[int]:
        low = (total + 1) // 2
        high = min(top, total - 1)
        if high < low:
            return []
        a = np.arange(high, low - 1, -1)
        fits = there[a] & there[total - a]
        if total % 2 == 0:
            fits[-1] = left[low] > 1
        i = int(fits.argmax())
        return [int(a[i]), int(total - a[i])] if fits[i] else []

    if found := two(gap, gap - 1):
        return found
    for a in np.flatnonzero(there[: max(gap - 1, 0)])[::-1].tolist():  # the largest of three
        if 3 * a <= gap:
            return [a, a, a] if 3 * a == gap and left[a] > 2 else []
        if found := two(gap - a, a if left[a] > 1 else a - 1):
            return [a, *found]
    return []


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) using up counts[length] exactly."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    if left[capacity]:
        out.append(([capacity], int(left[capacity])))
        left[capacity] = 0
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        free, content, gap = left.copy(), [top], capacity - top
        free[top] -= 1
        while gap:
            fill = exact_fill(gap, free)
            if fill:
                content += fill
                break
            fits = np.flatnonzero(free[: gap + 1])
            if not len(fits):
                break
            best = int(fits[-1])
            content.append(best)
            free[best] -= 1
            gap -= best
        times = min(int(left[x]) // k for x, k in Counter(content).items())
        for x, k in Counter(content).items():
            left[x] -= times * k
        out.append((content, times))


#: Ranks of one length stay below 2 ** RANK_BITS.
RANK_BITS = 48


def places(made: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of ranks by length: sorted keys (length and first rank), sequence of the first rank, offset in the sequence."""
    used: Counter = Counter()
    rows, base = [], 0
    for content, times in made:
        offset = 0
        for x in content:
            rows.append(((x << RANK_BITS) + used[x], base, offset))
            used[x] += times
            offset += x
        base += times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))


def _placed(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base, offset = told.value
        for batch in batches:
            *rest, rank = batch.columns
            length = batch.column(batch.schema.get_field_index("length"))
            key = (length.to_numpy() << RANK_BITS) + rank.to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*rest, pa.array(base[at] + key - keys[at]), pa.array(offset[at])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def told_apart(pieces: DataFrame) -> DataFrame:
    """pieces as a durable table with a number of its own for each row, so that equal rows spread over buckets."""
    return durable(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds sequence_id and offset to the rows of told_apart (length, uid and what else they have), without uid."""
    spark = ready(pieces)
    found = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in found:
        counts[r.length] = r.n
    told = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    buckets = max(1, -(-int(counts.sum()) // bucket_rows))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("uid")) - 1)
    kept = [c for c in pieces.columns if c != "uid"]
    ranked = own.join(before, ["length", "bucket"]).select(*kept, (F.col("before") + F.col("own")).alias("rank"))
    kinds = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in kept)
    return ranked.mapInArrow(_placed(told), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The layout: one row for each piece with its place."""
    return pack_pieces(told_apart(token_pieces(docs, tokenizer, capacity, doc_id, text)), capacity, bucket_rows)


def _joined(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("offset")
    return pa.table({"sequence_id": rows.column("sequence_id")[:1], "ids": pa.array([b"".join(rows.column("ids").to_pylist())], pa.binary())})


def sequence_tokens(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The sequences themselves: sequence_id and ids as little-endian 32-bit integers.

    Pieces carry their ids to their places, so null and repeated doc_ids and equal rows are packed like any other.
    """
    placed = pack_pieces(told_apart(token_pieces(docs, tokenizer, capacity, doc_id, text, with_ids=True)), capacity, bucket_rows)
    return placed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(_joined, "sequence_id long, ids binary")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
