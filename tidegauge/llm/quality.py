"""Quality rules by distribution divergence, with DataFrame functions only.

Two histograms of each document are held against those of all documents of its language: kinds of
characters (lower-case and other letters, capitals, digits, white space, punctuation, symbols) and the
language's ``COMMON`` most frequent short words (and all others). The Jensen-Shannon distance of each (the square
root of the divergence, base 2, so 0 to 1) has its threshold, and applies only to texts long enough to have
such a histogram.

One pass finds the common words, one takes every document's counts; references are sums of these counts.

Base rules: fewer than 20 words, or more than 30 % of the words in repeated 8-word windows, fail.

Defined cases: a null text has no words and fails the base; null languages are a language of their own;
rows that repeat others are judged alike; long texts are counted whole, in time n log n; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import let, total, words
from .shared import durable, pick

#: Fixed values of the base rules.
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
SYMBOLS = r"[#*$%&|<>]"
#: Characters by kind; what no pattern counts are lower-case and other letters.
KINDS = (r"\p{Lu}", r"\p{Nd}", r"[\x20\x09-\x0D]", r"[\p{P}&&[^#*$%&|<>]]", SYMBOLS)
COMMON = 16
COMMON_LENGTH = 5
#: Most that a document may differ from its language, and the least size to be judged.
CHARACTER_DISTANCE = 0.28
WORD_DISTANCE = 0.30
LEAST_CHARACTERS = 200
LEAST_COMMON_WORDS = 50


def common_words(docs: DataFrame, count: int = COMMON) -> DataFrame:
    """lang and its most frequent words of at most COMMON_LENGTH letters, as an array in order of frequency."""
    each = docs.select("lang", F.explode(F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: (w != "") & (F.length(w) <= COMMON_LENGTH) & (F.regexp_like(w, F.lit(r"^\p{L}+$"))))).alias("word"))
    counts = each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("at") <= count)
    return top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("common"))


def repeated_words(w: Column) -> Column:
    """Words that lie in a WINDOW-word window found twice or more."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(
            ordered,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["x"] == e["x"])) | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["x"] == e["x"]))),
                    lambda e: e["i"],
                )
            ),
        )
        return let(twice, lambda p: total(F.transform(p, lambda v, k: F.when(k + 1 < F.size(p), F.least(F.lit(WINDOW), F.get(p, k + 1) - v)).otherwise(F.lit(WINDOW)).cast("long"))))

    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(w) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame) -> DataFrame:
    """Counts of each document (columns doc_id, lang, text and common): the base features, kinds and common."""
    text = F.coalesce(F.col("text"), F.lit(""))
    all_common = F.col("common")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))

    def of_words(w: Column) -> Column:
        short = F.filter(F.transform(F.filter(w, lambda x: F.length(x) <= COMMON_LENGTH), lambda x: F.lower(x)), lambda x: F.array_contains(all_common, x))
        histogram = let(short, lambda s: F.transform(all_common, lambda c: F.size(F.filter(s, lambda x: x == c)).cast("long")))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), F.coalesce(histogram, F.array().cast("array<bigint>")).alias("common"))

    counted = docs.select(
        "doc_id",
        "lang",
        let(words(text), of_words).alias("w"),
        F.length(text).cast("long").alias("n_chars"),
        F.array(*[F.regexp_count(text, F.lit(k)).cast("long") for k in KINDS]).alias("kinds"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    return counted.select("doc_id", "lang", "w.n_words", (F.col("n_chars") - F.get("kinds", F.lit(2))).alias("word_chars"), F.get("kinds", F.lit(4)).alias("n_symbols"), "n_dup_lines", "w.n_repeat_words", F.concat("kinds", F.array(F.col("n_chars") - total(F.col("kinds")))).alias("kinds"), F.concat("w.common", F.array(F.col("w.n_words") - total(F.col("w.common")))).alias("common"))


def _sums(rows: DataFrame, column: str) -> DataFrame:
    each = rows.select("lang", F.posexplode(column).alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    return each.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias(f"ref_{column}"))


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts, 0 if one is empty."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    def shares(x: Column, n: Column) -> Column:
        return F.transform(x, lambda v: v / n)

    both = F.zip_with(shares(a, total(a)), shares(b, total(b)), lambda x, y: (part(x, y) + part(y, x)) / 2)
    return F.when((total(a) == 0) | (total(b) == 0), F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x))))


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", character_distance: float = CHARACTER_DISTANCE, word_distance: float = WORD_DISTANCE) -> DataFrame:
    """The base features of each row, both distances, base_failed and kept."""
    given = docs.select(*pick(docs, doc_id, lang, text)).toDF("doc_id", "lang", "text").withColumn("lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    common = durable(common_words(given), "common").withColumnRenamed("lang", "of")
    rows = durable(features(given.join(common, F.col("lang") == F.col("of"), "left").drop("of").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))), "features")
    refs = durable(_sums(rows, "kinds").join(_sums(rows, "common"), "lang"), "references").withColumnRenamed("lang", "of")
    judged = rows.join(refs, F.col("lang") == F.col("of"))
    judged = judged.withColumns({"character_distance": distance(F.col("kinds"), F.col("ref_kinds")), "word_distance": distance(F.col("common"), F.col("ref_common")), "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))})
    odd = ((total(F.col("kinds")) >= LEAST_CHARACTERS) & (F.col("character_distance") > character_distance)) | ((F.col("n_words") >= LEAST_COMMON_WORDS) & (F.col("word_distance") > word_distance))
    return judged.withColumn("kept", ~F.col("base_failed") & ~odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "character_distance", "word_distance")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("character_distance", "word_distance")
