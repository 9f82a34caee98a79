"""Language identification: script ranges, per-word scores and a Viterbi path over each text's words.

Learned from labelled texts: which scripts each language is written in, and its letter trigrams. A word's
script narrows the candidate languages; each candidate scores the word by its trigrams, against the mean of
the candidates. The Viterbi path over all words of a text, with a penalty for each switch, labels spans of
mixed-language text. The text's language is the one whose spans hold most letters, its score their share.

Training reads a bounded sample, ``TRAIN_DOCS`` labelled documents a language (chosen by a hash of their
ids), and keeps the most frequent trigrams of each language: ``GRAMS``, or with many languages as many as keep
the table of trigrams by languages within ``MODEL_CELLS`` numbers. Prediction reads every word of every text.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and no spans; so is any text if
nothing is learned. Words without letters belong to the span around them. Words in a script that no learned
language uses tell nothing. Null labels are not learned from; more than ``MAX_LANGUAGES`` labels are an error. Long texts are
labelled whole. An empty table gives an empty result; other columns are not read, and are kept by identified.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import ready
from .shared import memo, pick, text_array

#: First code points of ranges and the script there.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"),
    (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Other"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
)
STARTS = [x for x, _ in SCRIPTS]
TRAIN_DOCS = 1500
GRAMS = 60_000
#: A language is written in a script that holds this share of its training letters.
SCRIPT_SHARE = 0.02
#: Log-likelihood that a switch of language costs; and the most that one word can tell.
SWITCH = 6.0
WORD_MOST = 8.0
WORDS_HELD = 300_000
CHUNK = 4 << 20
MAX_LANGUAGES = 256
#: 32-bit numbers of the model's table, which is told to all tasks: 128 MB.
MODEL_CELLS = 1 << 25
UNKNOWN = "und"
#: identified() rejects a text of whose letters a smaller share is in words that some learned language may have written.
LEAST_KNOWN = 0.5


def script_of(letter: str) -> str:
    return SCRIPTS[bisect_right(STARTS, ord(letter)) - 1][1]


_SCRIPT: dict[str, str] = {}


def word_script(letters: str) -> str:
    """The script of most letters, the first of several as frequent."""
    if letters.isascii():
        return "Latin"
    for c in letters:
        if c not in _SCRIPT:
            _SCRIPT[c] = script_of(c)
    found = [_SCRIPT[c] for c in letters]
    return found[0] if found.count(found[0]) == len(found) else Counter(found).most_common(1)[0][0]


def _letters(word: str) -> str:
    return "".join(c for c in word if c.isalpha()).lower()


def _grams(letters: str) -> list[str]:
    padded = f"^^{letters}$"
    return [padded[i : i + 3] for i in range(len(letters) + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams (3 letters) and scripts (@name) by language of a task's share of the training sample."""
    found: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in Counter((text or "").split()).items():
                if letters := _letters(word):
                    for g in _grams(letters):
                        found[lang][g] += n
                    for c in letters:
                        found[lang]["@" + script_of(c)] += n
    rows = [(lang, g, n) for lang, counts in found.items() for g, n in counts.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])


class Model:
    """Languages, their scripts and the log-likelihood of a letter after two others in each."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.languages = sorted({r[0] for r in rows})
        index = {x: i for i, x in enumerate(self.languages)}
        n = len(self.languages)
        scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        for lang, g, k in rows:
            (scripts if g[0] == "@" and len(g) != 3 else grams)[g.removeprefix("@") if g[0] == "@" and len(g) != 3 else g][index[lang]] += k
        whole = sum(scripts.values()) if scripts else np.ones(n)
        self.used = {s: x / np.maximum(whole, 1) >= SCRIPT_SHARE for s, x in scripts.items()}
        before: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        for g, x in grams.items():
            before[g[:2]] += x
        letters = len({g[2] for g in grams}) + 1
        self.grams = {g: np.log((x + 0.1) / (before[g[:2]] + 0.1 * letters)) for g, x in grams.items()}
        self.unseen = math.log(1 / letters)
        self.index = {g: i + 1 for i, g in enumerate(self.grams)}
        self.table = np.stack([np.full(n, self.unseen), *self.grams.values()]).astype(np.float32)
        del self.grams

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores by language, letters, letters in a script that some language uses) of words, one row for each."""
        score, count = np.zeros((len(words), len(self.languages)), np.float32), np.zeros(len(words), np.int64)
        known = np.zeros(len(words), np.int64)
        flat: list[int] = []
        first, rows, scripts = [], [], defaultdict(list)
        index = self.index.get
        for i, word in enumerate(words):
            letters = word.lower() if word.isalpha() else _letters(word)
            if not letters:
                continue
            count[i] = len(letters)
            scripts[word_script(letters)].append(len(rows))
            rows.append(i)
            first.append(len(flat))
            padded = f"^^{letters}$"
            flat += [index(padded[k : k + 3], 0) for k in range(len(padded) - 2)]
        if rows and len(self.languages):
            total = np.add.reduceat(self.table[flat], first, axis=0)
            for script, own in scripts.items():
                may = self.used.get(script)
                if may is None or not may.any():
                    total[own] = 0
                    continue
                part = total[own]
                part = np.clip(part - part[:, may].mean(axis=1, keepdims=True), -WORD_MOST, WORD_MOST)
                part[:, ~may] = -2 * WORD_MOST
                total[own] = part
                at = np.array(rows)[own]
                known[at] = count[at]
            score[rows] = total
        return score, count, known


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """A model from documents outside the held-out third."""
    spark = ready(docs)
    rows = docs.select(*pick(docs, doc_id, text, lang)).toDF("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, train_docs / r.n))]) if sizes else F.lit(None)
    if not sizes:
        return Model([])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30))
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the sample bounds the counts; a table of n languages has n times these rows at most, and n columns
    grams = min(GRAMS, MODEL_CELLS // len(sizes) ** 2)
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    kept = ranked.where(F.col("rank") <= grams).orderBy(F.desc("n"), "lang", "gram").collect()
    return Model([(r.lang, r.gram, r.n) for r in kept])


def viterbi(score: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each step, for several texts at once. score: (texts, steps, languages)."""
    texts, steps, n = score.shape
    best, came = score[:, 0].copy(), np.zeros((steps, texts, n), np.uint16)
    stay = np.arange(n, dtype=np.uint16)[None, :]
    for t in range(1, steps):
        top = best.argmax(axis=1)
        jump = best[np.arange(texts), top] - switch
        better = jump[:, None] > best
        came[t] = np.where(better, top[:, None].astype(np.uint16), stay)
        best = np.where(better, jump[:, None], best) + score[:, t]
    label = np.zeros((texts, steps), np.int64)
    at = best.argmax(axis=1)
    rows = np.arange(texts)
    for t in range(steps - 1, -1, -1):
        label[:, t] = at
        at = came[t][rows, at]
    return label


class Scores:
    """Rows of scores by word as written, bounded in number."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        n = len(self.model.languages)
        self.scores, self.letters, self.known = np.zeros((1 << 16, n), np.float32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 1  # row 0 tells nothing

    def learn(self, words: set[bytes]) -> None:
        if len(self.row) + len(words) > WORDS_HELD:
            self.clear()
        new = [w for w in words if w not in self.row]
        end = self.used + len(new)
        while end > len(self.letters):
            self.scores, self.letters, self.known = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.letters, self.known))
        self.scores[self.used : end], self.letters[self.used : end], self.known[self.used : end] = self.model.words([w.decode() for w in new])
        self.row.update(zip(new, range(self.used, end)))
        self.used = end


def label_texts(texts: list[bytes], held: Scores, spans: bool) -> list[tuple[str, float, float, list | None]]:
    """(language, score, known share of letters, spans) of each text; a span is (first word, end word, language)."""
    words = [x.split() for x in texts]
    held.learn(set().union(*words))
    get = held.row.__getitem__
    row = [np.fromiter(map(get, w), np.int64, len(w)) for w in words]
    scores, letters = held.scores, held.letters
    names, n = held.model.languages, len(held.model.languages)
    out: list = [(UNKNOWN, 0.0, 0.0, [] if spans else None)] * len(texts)
    order = sorted((i for i in range(len(texts)) if n and letters[row[i]].any()), key=lambda i: len(row[i]))
    k = 0
    while k < len(order):
        group = [order[k]]
        most = max(64, int(1.5 * len(row[order[k]])))
        while k + len(group) < len(order) and len(row[order[k + len(group)]]) <= most and (len(group) + 1) * len(row[order[k + len(group)]]) * n < 4_000_000:
            group.append(order[k + len(group)])
        k += len(group)
        steps = len(row[group[-1]])
        table = np.zeros((len(group), steps), np.int64)
        for j, i in enumerate(group):
            table[j, : len(row[i])] = row[i]
        label = viterbi(scores[table], SWITCH)
        weight = letters[table]
        share = np.stack([(weight * (label == x)).sum(axis=1) for x in range(n)], axis=1)
        for j, i in enumerate(group):
            best = int(share[j].argmax())
            own = None
            if spans:
                path = label[j, : len(row[i])]
                cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                own = [(a, b, names[path[a]]) for a, b in zip(cut, cut[1:])]
            every = int(share[j].sum())
            out[i] = (names[best], float(share[j, best] / every), float(held.known[row[i]].sum() / every), own)
    return out


def _predicted(told, key: str, spans: bool, at: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = memo(("language_id", key), lambda: Scores(told.value))
        for batch in batches:
            texts, found = text_array(batch.column(at)).cast(pa.binary()), []
            held, size = [], 0
            for x in texts:
                held.append(x.as_py())
                size += len(held[-1])
                if size >= CHUNK:
                    found += label_texts(held, scores, spans)
                    held, size = [], 0
            found += label_texts(held, scores, spans) if held else []
            cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            if spans:
                cols.append(pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in f[3]] for f in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *cols], names=[*batch.schema.names[:kept], "lang_pred", "score", "known", *(["spans"] if spans else [])])

    return run


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text", spans: bool = False) -> DataFrame:
    """The columns to keep (as c0, c1 ...) with lang_pred, score, known (share of letters in scripts of learned languages) and, if asked for, spans (in words)."""
    told = ready(docs).sparkContext.broadcast(model)  # MODEL_CELLS numbers and their trigrams at most
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(keep)), "lang_pred string, score double, known double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans])
    given = keep if text in keep else [*keep, text]
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(given)]).mapInArrow(_predicted(told, uuid.uuid4().hex, spans, given.index(text), len(keep)), schema)


def identified(docs: DataFrame, least: float = LEAST_KNOWN, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, all columns kept, whose language is found; texts of several languages too, if at least that share of their letters is in scripts of learned languages."""
    names = docs.columns
    found = predict(docs, train(docs, doc_id, text, lang), names, text)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= least)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def held_out(doc_id: str = "doc_id"):
    """Whether a document is outside the rows to learn from; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs), ["doc_id"]).withColumnRenamed("c0", "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
