"""N-gram Jaccard join over word shingles.

Texts become sets of hashed five-word shingles. Rows with equal sets are one class. Two sets with a
similarity of 0.8 share at least one of the first fifth of their shingles in any fixed order; here frequent
shingles come last, the others by hash. Rows of one such shingle make its tile, cut into bands: sizes in a
band are within a factor of 1.25 of its first row's, the one with the fewest infrequent shingles. Hashed bitmaps of about as many bits as the
set has shingles bound each pair's overlap from above: a bit that only one of them has is a shingle that
the other lacks. What the bound leaves is decided by intersecting the sorted arrays.

Round one compares each member of a band with its first; what links joins into components. Round two takes
the tiles in which several components still meet, and compares all pairs across them whose sizes allow a
link. So no link between components is lost, and large groups of near copies cost one comparison a member
and tile band instead of all pairs.

No task holds a whole tile. Round one streams it and remembers only the first rows of its bands. Tiles of shingles that
very many texts have are dealt over several tasks, whose first rows then meet in bands of their own. Round two
cuts tiles into blocks of ``TILE_ROWS`` rows and compares each pair of blocks as a unit.

"Frequent" is found by counting every text's shingles in stretches of about four million, where those found twice are counted; any choice gives
the same links, so its table is bounded (``MAX_HOT``). Sets are made anew only for texts in pairs that the
bound leaves, told by a bounded Bloom filter.

Defined cases: texts with fewer words than a shingle are one shingle of all their words; texts that are null
or have no words have the empty set and link with nothing; rows that repeat others link; null doc_ids do
not name a component unless all its rows have none. Very long words and texts are hashed whole. An empty
table gives an empty result; other columns are not read, and are kept by near_dedup.

jaccard_links decides all pairs of classes instead of what components need, so it costs the square of a group of near
copies; jaccard_components doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import ready
from .bloom import key_filter
from .components import components
from .shared import IS_BREAK, durable, join_groups, mix64, pick, random_table, release, text_array, text_buffer

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A shingle is frequent from so many texts on; at most MAX_HOT of them are told to all tasks (16 MB).
HOT_FROM = 6
MAX_HOT = 1 << 21
STRETCH = 1 << 22
#: Rows of a tile that are compared as a block, and texts with a shingle from which on its tile is dealt over several tasks.
TILE_ROWS = 1 << 14
DEALT_FROM = 1 << 17
MOST_BITS = 1 << 15
MAX_FILTER_BYTES = 32 << 20
#: Rows to drop are broadcast up to this number, and joined by shuffle beyond it.
MAX_BROADCAST = 500_000
#: Bytes of a text that are hashed at once.
SEGMENT = 1 << 20

_BYTES = random_table(256, 11)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)
_MIX = random_table(WORDS * 4, 12) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(2 * n, _BASE)
        steps[0] = 1
        _POWERS = np.cumprod(steps)
    return _POWERS


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a text's bytes, A-Z lower-cased."""
    if len(raw) > SEGMENT:  # cut at the first break after each segment
        out, begin = [], 0
        while begin < len(raw):
            end = begin + SEGMENT
            if end < len(raw):
                rest = np.flatnonzero(IS_BREAK[raw[end : end + SEGMENT]])
                while not len(rest) and end + SEGMENT < len(raw):
                    end += SEGMENT
                    rest = np.flatnonzero(IS_BREAK[raw[end : end + SEGMENT]])
                end = end + int(rest[0]) if len(rest) else len(raw)
            out.append(_hash_words(raw[begin:end]))
            begin = end
        return np.concatenate(out)
    return _hash_words(raw)


def _hash_words(raw: np.ndarray) -> np.ndarray:
    inside = ~IS_BREAK[raw]
    if not inside.any():
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    begin, end = edge[0::2], edge[1::2]
    size = end - begin
    value = _BYTES[_LOWER[raw[inside]]]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    value *= _powers(int(size.max()))[np.arange(len(value)) - np.repeat(first, size)]
    return mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * _MIX[-1])


def shingles(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles."""
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    total = np.full(n - k + 1, np.uint64(0) if n >= width else _MIX[WORDS + n], np.uint64)
    for i in range(k):
        total += words[i : n - k + 1 + i] * _MIX[i % WORDS] * _powers(i // WORDS + 1)[i // WORDS]
    return np.unique(mix64(total))


def sets_of(column: pa.Array, width: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of each text, or of those wanted."""
    offsets, raw = text_buffer(text_array(column))
    for i in range(len(column)) if wanted is None else np.flatnonzero(wanted):
        yield int(i), shingles(word_hashes(raw[offsets[i] : offsets[i + 1]]), width)


def class_of(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def bitmap(own: np.ndarray) -> bytes:
    """A bit for each hash, in the least power of two that is not below their number."""
    size = min(MOST_BITS, max(64, 1 << (len(own) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[(mix64(own) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def overlap_bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    x, y = _folded(x, size), _folded(y, size)
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def links(overlap: int, n_a: int, n_b: int) -> bool:
    return 100 * overlap >= PERCENT * (n_a + n_b - overlap)


def _counted(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, size, seen = [], 0, set()

        def send() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["key", "n"])

        for batch in batches:
            for _, own in sets_of(batch.column(0), width):
                if (k := class_of(own)) not in seen:  # copies within a stretch count once
                    seen.add(k)
                    held.append(own)
                    size += len(own)
                    if size >= STRETCH:
                        yield send()
                        held, size, seen = [], 0, set()
        if size:
            yield send()

    return run


def frequent_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most MAX_HOT of the most frequent shingles, and how many texts have each."""
    counts = durable(texts.mapInArrow(_counted(width), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_FROM), "frequent")
    level = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.level):  # a few hundred rows
        total += r.n
        if total > MAX_HOT:
            break
        least = r.level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.where(level >= least).select("key", "n").toArrow()
    keys = found.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy().astype(np.int64)[order]


def _sketched(told, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hot, seen = told.value, set()
        for batch in batches:
            size, kind, prefix, bits, rare = [], [], [], [], []
            for _, own in sets_of(batch.column(batch.num_columns - 1), width):
                n = len(own)
                size.append(n)
                kind.append(k := class_of(own) if n else None)
                if k is None or k in seen:
                    prefix.append(None)
                    bits.append(None)
                    rare.append(None)
                    continue
                seen.add(k)
                often = np.zeros(n, bool)
                if len(hot):
                    at = np.searchsorted(hot, own)
                    at[at == len(hot)] = 0
                    often = hot[at] == own
                order = np.concatenate([np.flatnonzero(~often), np.flatnonzero(often)])
                prefix.append(own[order[: n - -(-PERCENT * n // 100) + 1]].tobytes())
                bits.append(bitmap(own))
                rare.append(n - int(often.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size, pa.int64()), pa.array(kind, pa.binary()), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary()), pa.array(rare, pa.int64())], names=[*batch.schema.names[:-1], "n", "cls", "prefix", "bits", "rare"])

    return run


def _exploded(dealt):
    """A row for each shingle of a prefix. dealt: sorted shingles whose tiles are dealt, and over how many tasks each; other rows have the deal -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, tasks = dealt.value
        for batch in batches:
            rep, n, rare = (c.to_numpy() for c in batch.columns[:3])
            keys = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            size = np.array([len(k) for k in keys], np.int64)
            ends = np.cumsum(size)
            cut = [0, *np.flatnonzero(np.diff(ends // (1 << 16), prepend=0)).tolist(), len(keys)]
            for a, b in zip(cut, cut[1:]):
                if b > a:
                    times = size[a:b]
                    place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    key, own = np.concatenate(keys[a:b]), np.repeat(rep[a:b], times)
                    deal = np.full(len(key), -1, np.int64)
                    if len(many):
                        at = np.searchsorted(many, key)
                        at[at == len(many)] = 0
                        hit = np.flatnonzero(many[at] == key)
                        deal[hit] = (mix64(own[hit].view(np.uint64)) % tasks[at[hit]].astype(np.uint64)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, deal, np.repeat(rare[a:b], times), own, np.repeat(n[a:b], times), place)], names=["key", "deal", "rare", "rep", "n", "place"])

    return run


def may_link(n_a: np.ndarray, at_a: np.ndarray, n_b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Whether sets could link if the shingle at these places is the first that they share: what stands before it is not shared."""
    return (100 + PERCENT) * np.minimum(n_a - at_a, n_b - at_b) >= PERCENT * (n_a + n_b)


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns as arrays, in stretches that end where a key (the first column) ends."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if last:
            yield [np.concatenate(x) for x in zip(*held, [c[:last] for c in cols])]
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[np.ndarray], int]]:
    """Columns as arrays, in stretches that end where a tile (its key and deal, the first two columns) ends or has most rows or more; and how many rows of the first tile came before."""
    held: list[list[np.ndarray]] = []
    size, tile, before = 0, None, 0

    def joined(parts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], int]:
        cols = [np.concatenate(x) for x in zip(*parts)]
        return cols, before if (cols[0][0], cols[1][0]) == tile else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        last = int(other[-1]) + 1 if len(other) else 0
        if last or (held and (held[-1][0][-1], held[-1][1][-1]) != (cols[0][0], cols[1][0])):
            yield joined([*held, [c[:last] for c in cols]])
            held, size = [], 0
        held.append([c[last:] for c in cols])
        size += len(held[-1][0])
        if size >= most:
            out, before = joined(held)
            yield out, before
            tile, before = (out[0][-1], out[1][-1]), before + len(out[0])
            held, size = [], 0
    if held:
        yield joined(held)


def _led(n: np.ndarray, rep: np.ndarray, place: np.ndarray, leads: list[tuple]) -> np.ndarray:
    """Which of the leads (n, rep, place) each row of a tile has; rows outside all their bands become leads. Sizes of leads differ by more than a band, so they are few."""
    out = np.full(len(n), -1)
    for i, lead in enumerate(leads):
        out[(out < 0) & (PERCENT * n <= 100 * lead[0]) & (PERCENT * lead[0] <= 100 * n)] = i
    while (out < 0).any():
        first = int(np.argmax(out < 0))
        leads.append((n[first], rep[first], place[first]))
        out[(out < 0) & (PERCENT * n <= 100 * n[first]) & (PERCENT * n[first] <= 100 * n)] = len(leads) - 1
    return out


def _bands(most: int):
    """Tiles of at least two rows, each row with the first of its band. Rows come by the number of shingles that are not frequent, so the one that has least of its own leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads: list[tuple] = []
        for (key, deal, rare, rep, n, place), before in _stretches(batches, most):
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (deal[1:] != deal[:-1])]))
            size = np.diff(np.append(begin, len(key)))
            lead = np.repeat(begin, size)
            lead_n, lead_rep, lead_place = n[lead], rep[lead], place[lead]
            least, most_n = np.minimum.reduceat(n, begin), np.maximum.reduceat(n, begin)
            several = (PERCENT * most_n > 100 * n[begin]) | (PERCENT * n[begin] > 100 * least)  # tiles of several bands
            several[-1] = True  # may go on in the next stretch
            several[0] |= before > 0
            for i in np.flatnonzero(several):
                if i or not before:
                    leads = []
                own = slice(begin[i], begin[i] + size[i])
                at = _led(n[own], rep[own], place[own], leads)
                lead_n[own], lead_rep[own], lead_place[own] = (np.array(x)[at] for x in zip(*leads))
            earlier = np.zeros(len(size), np.int64)
            earlier[0] = before
            block = (np.arange(len(key)) - lead + np.repeat(earlier, size)) // most + (np.maximum(deal, 0) << 32)
            keep = np.repeat((size > 1) | (earlier > 0), size) | (deal >= 0)
            tried = may_link(n, place, lead_n, lead_place)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, deal, block, rep, n, place, lead_rep, tried)], names=["key", "deal", "block", "rep", "n", "place", "lead", "tried"])

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of a unit (one block, side 0, or two, sides 1 and 2) in different components that may link, but for those of round one and of one side of two."""
    for unit, side, n, rep, place, lead, comp in _whole_runs(batches):
        begin = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        for i, j in zip(begin, np.append(begin[1:], len(unit))):
            if (comp[i:j] == comp[i]).all():
                continue
            for k in range(i, j - 1):  # sorted by n: partners of k end where sizes no longer allow a link
                end = i + int(np.searchsorted(n[i:j], 100 * n[k] / PERCENT, side="right"))
                other = np.arange(k + 1, end)
                other = other[(comp[other] != comp[k]) & (lead[other] != rep[k]) & (lead[k] != rep[other]) & may_link(n[k], place[k], n[other], place[other]) & ((side[other] != side[k]) | (side[k] == 0))]
                if len(other):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[k], rep[other])), pa.array(np.maximum(rep[k], rep[other]))], names=["a", "b"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n_a, n_b, x, y = (c.to_pylist() for c in batch.columns)
        keep = [links(overlap_bound(x[i], y[i], n_a[i], n_b[i]), n_a[i], n_b[i]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([p, q])
            both.sort(kind="stable")
            keep.append(links(int((both[1:] == both[:-1]).sum()), len(p), len(q)))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def _sets(told, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = told.value.contains(batch.column(0).to_numpy().view(np.uint64)) if batch.num_rows else np.zeros(0, bool)
            kind, data, size = [], [], 0
            for _, own in sets_of(batch.column(1), width, hit):
                if len(own):
                    kind.append(class_of(own))
                    data.append(own.tobytes())
                    size += len(data[-1])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.binary()), pa.array(data, pa.binary())], names=["cls", "own"])
                        kind, data, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.binary()), pa.array(data, pa.binary())], names=["cls", "own"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, doc_id: str, text: str, width: int, tile_rows: int, dealt_from: int):
        self.width, self.tile_rows, self.spark = width, tile_rows, ready(docs)
        self.docs = docs.select(*pick(docs, doc_id, text)).toDF("doc_id", "text")
        keys, times = frequent_shingles(self.docs.select("text"), width)
        hot = self.spark.sparkContext.broadcast(keys)
        many, tasks = keys[times >= dealt_from].view(np.int64), -(-times[times >= dealt_from] // dealt_from) + 1
        order = np.argsort(many)
        self.dealt = self.spark.sparkContext.broadcast((many[order], tasks[order]))
        kind = docs.schema[doc_id].dataType.simpleString()
        given = self.docs.select("doc_id", F.xxhash64("text").alias("row"), F.monotonically_increasing_id().alias("uid"), "text")
        self.table = durable(given.mapInArrow(_sketched(hot, width), f"doc_id {kind}, row long, uid long, n long, cls binary, prefix binary, bits binary, rare long"), "sketches")
        first = self.table.where("cls is not null").groupBy("cls").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times"))
        self.classes = durable(first, "classes")
        self.bits = self.table.where("bits is not null").select("cls", "bits")

    def decided(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b: rep of their classes) that link."""
        bits = self.classes.select("rep", "cls", "n").join(self.bits.dropDuplicates(["cls"]), "cls")
        side = lambda x: bits.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
        known = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
        left = durable(known.mapInArrow(_bounded, "a long, b long"), "bounded")
        ends = left.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        named = durable(self.classes.select("rep", "cls", "first_doc").join(ends, "rep"), "ends")
        if not (n := named.count()):
            return left
        wanted = self.spark.sparkContext.broadcast(key_filter(self.table.join(named.select(F.col("rep").alias("uid")), "uid").select(F.xxhash64("doc_id").alias("key")), n, MAX_FILTER_BYTES))
        sets = self.docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(_sets(wanted, self.width), "cls binary, own binary")
        own = durable(named.join(sets, "cls").groupBy("rep").agg(F.first("own").alias("own")), "sets")
        full = left.join(own.withColumnRenamed("own", "own_b"), left.b == own.rep).drop("rep").join(own.withColumnRenamed("own", "own_a"), F.col("a") == F.col("rep")).select("a", "b", "own_a", "own_b")
        return durable(full.mapInArrow(_decided, "a long, b long"), "links")

    def _banded(self, rows: DataFrame) -> DataFrame:
        types = "key long, deal long, block long, rep long, n long, place long, lead long, tried boolean"
        return rows.repartition("key", "deal").sortWithinPartitions("key", "deal", "rare", "n", "rep").mapInArrow(_bands(self.tile_rows), types)

    def tiles(self) -> DataFrame:
        """Rows of tiles: key, deal, block, rep, n, place, the first of the row's band (lead), and whether the two may link (tried)."""
        one = self.table.where("prefix is not null").groupBy("cls").agg(F.min_by(F.struct("n", "rare", "prefix"), "uid").alias("x"))
        rows = one.join(self.classes.select("cls", "rep"), "cls").select("rep", "x.n", "x.rare", "x.prefix")
        postings = rows.mapInArrow(_exploded(self.dealt), "key long, deal long, rare long, rep long, n long, place long")
        return durable(self._banded(postings), "tiles")

    def first_round(self, tiles: DataFrame) -> DataFrame:
        tried = tiles
        if len(self.dealt.value[0]):  # the first rows of a dealt tile's parts meet in bands of their own
            firsts = tiles.where("deal >= 0 and rep = lead").select("key", F.lit(-1).cast("long").alias("deal"), F.lit(0).cast("long").alias("rare"), "rep", "n", "place")
            tried = tried.unionByName(self._banded(firsts))
        return self.decided(tried.where("tried and rep <> lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct())

    def second_round(self, rows: DataFrame) -> DataFrame:
        """Links between rows of different comp, but for those of the first round. rows: those of tiles, with comp."""
        given = rows.select("key", "block", "n", "rep", "place", F.when(F.col("tried"), F.col("lead")).otherwise(-1).alias("lead"), "comp")
        told = ("n", "rep", "place", "lead", "comp")
        units = given.select(F.col("key").alias("unit"), F.lit(0).alias("side"), *told)
        large = durable(rows.where("block > 0").select("key").distinct(), "large")
        if not large.isEmpty():
            # tiles of several blocks in which several components meet: a row goes to each pair of blocks that has its own
            blocks = given.join(large, "key").groupBy("key").agg(F.collect_set("block").alias("blocks"), F.min("comp").alias("low"), F.max("comp").alias("high"))
            pairs = given.join(blocks.where("low <> high").select("key", "blocks"), "key").withColumn("other", F.explode("blocks"))
            side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
            unit = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
            units = given.join(large, "key", "left_anti").select(*units.columns[2:], F.col("key").alias("unit"), F.lit(0).alias("side")).unionByName(pairs.select(unit.alias("unit"), side.alias("side"), *told))
        return self.decided(units.select("unit", "side", *told).repartition("unit").sortWithinPartitions("unit", "n", "rep").mapInArrow(_across, "a long, b long").distinct())

    def components(self) -> DataFrame:
        """node and label of the classes (rep) that link with others."""
        tiles = self.tiles()
        first = self.first_round(tiles)
        found = components(first)
        second = self.second_round(tiles.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")))
        return components(first.unionByName(second))

    def links(self) -> DataFrame:
        """All pairs (a, b: rep) of classes that link."""
        tiles = self.tiles()
        return durable(self.first_round(tiles).unionByName(self.second_round(tiles.withColumn("comp", F.col("rep")))).distinct(), "links")

    def with_classes(self, of: DataFrame) -> DataFrame:
        """The rows that have shingles (doc_id, row, n) with the columns of their class (cls, times and others)."""
        rows = self.table.where("cls is not null").select("doc_id", "row", "n", "cls")
        return join_groups(rows, of, ["cls"], "times", self.table.count())

    def empty(self) -> DataFrame:
        return self.table.where("cls is null").select("doc_id", "n")


def _labelled(join: _Join) -> DataFrame:
    """cls, first_doc, times and label (the component's rep) of each class."""
    found = join.components()
    return durable(join.classes.join(found, F.col("rep") == F.col("node"), "left").select("cls", "first_doc", "times", F.coalesce("label", "rep").alias("label")), "labels")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS, tile_rows: int = TILE_ROWS, dealt_from: int = DEALT_FROM) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id it can reach) of each row."""
    join = _Join(docs, doc_id, text, width, tile_rows, dealt_from)
    named = _labelled(join)
    least = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    of = durable(named.join(least, "label").select("cls", "times", "component_id"), "of")
    some = join.with_classes(of).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(join.empty().select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS, tile_rows: int = TILE_ROWS, dealt_from: int = DEALT_FROM) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, class_id, n_links: how many other rows link with it), and all links between different classes (class_a, class_b)."""
    join = _Join(docs, doc_id, text, width, tile_rows, dealt_from)
    side = join.classes.select("rep", "cls", "times")
    pairs = join.links()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(side.select(F.col("rep").alias("b"), "times"), "b").groupBy("a").agg(F.sum("times").alias("others"))
    of = durable(side.join(linked, F.col("rep") == F.col("a"), "left").select("cls", "times", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "of")
    name = lambda c: F.lower(F.hex(c))
    some = join.with_classes(of).select("doc_id", F.col("n").alias("n_shingles"), name("cls").alias("class_id"), "n_links")
    rows = some.unionByName(join.empty().select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("string").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
    ends = [side.select(F.col("rep").alias(x), name("cls").alias(f"class_{x}")) for x in ("a", "b")]
    return rows, pairs.join(ends[0], "a").join(ends[1], "b").select("class_a", "class_b")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS, tile_rows: int = TILE_ROWS, dealt_from: int = DEALT_FROM) -> DataFrame:
    """The documents, all columns kept, but one of each component: the row with the smallest doc_id (null ids last). Texts without words all stay."""
    join = _Join(docs, doc_id, text, width, tile_rows, dealt_from)
    rows = join.with_classes(_labelled(join).select("cls", "times", "label"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    rows = durable(rows.groupBy("label", "doc_id", "row").agg(F.count(F.lit(1)).alias("times")), "rows")
    best = durable(rows.groupBy("label").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("members")), "best")
    marked = durable(join_groups(rows, best, ["label"], "members", rows.count()).withColumn("kept", order == F.col("best")).where("not kept or times > 1").select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "kept"), "marked")
    n = marked.count()
    told = F.broadcast(marked) if n <= MAX_BROADCAST else marked  # 40 bytes a row
    names = docs.columns
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    id_, body = F.col(f"c{names.index(doc_id)}"), F.col(f"c{names.index(text)}")
    out = held.join(told, id_.eqNullSafe(F.col("__id")) & (F.xxhash64(body) == F.col("__row")), "left").where("kept is null or kept")
    single = out.where("kept is null").select(*held.columns)
    if marked.where("kept").limit(1).count():  # kept rows that repeat each other whole
        single = single.unionByName(out.where("kept").dropDuplicates(["__id", "__row"]).select(*held.columns))
    return single.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
