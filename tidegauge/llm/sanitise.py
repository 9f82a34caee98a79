"""Personal data by patterns, and information-theoretic sanitisation, with DataFrame functions only.

Patterns find e-mail addresses, internet addresses, card numbers (Luhn) and phone numbers. Their values are
the protected entities. Terms (words of at least three letters) anywhere in a document with an entity may
reveal it: from corpus counts, the pointwise mutual information of entity and term over the entity's
information content, log(N p(e|t) / n(e)) / log(N / n(e)), says which share of the entity the term
discloses; 1 means that whoever reads the term knows the entity. p(e|t) is smoothed towards the entity's share
of all documents, as if ``PRIOR`` more documents with the term had been seen (the weight of Laplace's rule):
(n(e,t) + PRIOR n(e) / N) / (n(t) + PRIOR). So every entity is judged, those of one document too, and few
documents tell less than many. A term that discloses at least ``DISCLOSURE`` of an entity is a finding too
wherever it stands in a document with that entity, outside the findings of patterns. Sanitising writes entities as their kind and removes or generalises such terms.

Counts are of whole documents, over all documents. Pairs are aggregated before they are shuffled, so a group of copies
costs a row for each task; entities of the same documents are judged once.

Defined cases: a null text is empty and has no findings; equal rows have equal findings; findings may
overlap across kinds and are all reported; matches that fail their test (parts, Luhn, digits) are dropped and
not tried again. Long texts are searched whole: the patterns take time linear in them. An empty table gives
an empty result; other columns are not read, and are kept by sanitise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, matches
from .shared import durable, pick

#: Kinds in order, and the patterns. They match the same as [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), [0-9]([\x20-]?[0-9])+ (and single digits, which its length test drops) and
#: \+[0-9][\x20().0-9-]+[0-9], but without going back over long runs: a match begins where a run does or the last match ended.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"
TERM = r"\p{L}{3,}"
TERM_KIND = "term"
PRIOR = 2.0
DISCLOSURE = 0.8
FOUND = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def base_findings(text: Column) -> Column:
    """Findings of the patterns, sorted by start and kind."""
    none = F.array().cast(FOUND)
    digits = lambda x, drop: F.regexp_replace(x, drop, "")

    def of(kind: int, may: Column, pattern: str, holds) -> Column:
        kept = F.transform(F.filter(matches(text, pattern), lambda m: holds(m["value"])), lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(may, kept).otherwise(none)

    return F.array_sort(
        F.concat(
            of(0, F.contains(text, F.lit("@")), EMAIL, lambda v: F.lit(True)),
            of(1, F.regexp_like(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), IP, lambda v: F.regexp_like(v, F.lit(IP_PARTS))),
            of(2, F.regexp_like(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), CARD, lambda v: let(digits(v, r"[\x20-]"), lambda d: F.length(d).between(12, 19) & _luhn(d))),
            of(3, F.regexp_like(text, F.lit(r"\+[0-9]")), PHONE, lambda v: F.length(digits(v, r"[^0-9]")).between(9, 15)),
        )
    )


def _luhn(d: Column) -> Column:
    """Whether digits pass Luhn's test."""
    return F.call_function("luhn_check", d)


def written(found: Column) -> Column:
    """kind:start:end of findings, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM_KIND)])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def _terms(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _places(text: Column, base: Column, told: Column) -> Column:
    """Where the terms of told (sorted) stand outside the findings of base: as findings. Each word is looked up by halving."""

    def upto(term: Column, steps: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.size(told)) & (F.get(told, n + s - 1) <= term), n + s).otherwise(n))

    def placed(steps: Column) -> Column:
        words = F.transform(matches(text, TERM), lambda m: F.struct(m["start"], F.lit(len(KINDS)).alias("kind"), m["end"], F.lower(m["value"]).alias("value")))
        meant = F.filter(words, lambda t: F.coalesce(F.get(told, upto(t["value"], steps) - 1) == t["value"], F.lit(False)))
        return F.filter(meant, lambda t: ~F.exists(base, lambda x: (t["start"] < x["end"]) & (t["end"] > x["start"])))

    return let(F.filter(F.array(*[F.lit(2**k) for k in range(29, -1, -1)]), lambda s: s <= F.size(told)), placed)


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, row (hash of the text), base and found (all findings) of each row."""
    given = docs.select(*pick(docs, doc_id), F.coalesce(F.col(f"`{text}`"), F.lit(""))).toDF("doc_id", "text")
    based = given.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.xxhash64("text").alias("row"), "text", base_findings(F.col("text")).alias("base"))
    rows = durable(based.select("doc_id", "uid", "row", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "findings")
    total = rows.count()
    held = rows.where("text is not null")
    entity = F.array_distinct(F.transform("base", lambda x: F.concat_ws(":", x["kind"], F.lower(x["value"]))))
    of = held.select("uid", F.explode(entity).alias("entity"))
    # entities of the same documents are told by the same terms, and count as one: a set of documents is known by its size and two hashes
    key = ["n_e", "set_a", "set_b"]
    sets = of.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.bit_xor(F.xxhash64("uid")).alias("set_a"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("set_b"))
    classes = of.join(sets, "entity").groupBy("uid").agg(F.collect_set(F.struct(*key)).alias("sets"))
    near = durable(held.select("uid", _terms(F.col("text")).alias("terms")).join(classes, "uid"), "near")
    near = near.select("uid", F.explode("sets").alias("s"), "terms").select("uid", "s.*", F.explode("terms").alias("term"))
    pairs = near.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n_et"))
    # a term's documents: each task sends a word once with its count, and only counts are joined
    # (a semi join of the few terms asked for would be pushed below the count, to every place they stand at)
    each = given.select(F.explode(_terms(F.col("text"))).alias("term"))
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    share = F.col("n_e") / F.lit(float(total))
    told = F.lit(1.0) - F.log((F.col("n_et") + PRIOR * share) / (F.col("n_t") + PRIOR)) / F.log(share)
    revealing = durable(pairs.join(counts, "term").where((F.col("n_e") < total) & (told >= disclosure)).select(*key, "term"), "revealing")
    more = near.join(revealing, [*key, "term"]).groupBy("uid").agg(F.sort_array(F.collect_set("term")).alias("told"))
    found = F.when(F.col("told").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", _places(F.col("text"), F.col("base"), F.col("told")).cast(FOUND))))
    return rows.join(more, "uid", "left").select("doc_id", "row", "base", found.alias("found"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", generalise: bool = True, **more) -> DataFrame:
    """The documents, all columns kept, with entities written as [EMAIL] and so on, and revealing terms as [TERM] or removed."""
    names = docs.columns
    found = findings(docs, doc_id, text, **more).where(F.size("found") > 0).groupBy("doc_id", "row").agg(F.first("found").alias("found")).toDF("__id", "__row", "__found")
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    id_, body = F.col(f"c{names.index(doc_id)}"), F.col(f"c{names.index(text)}")
    joined = held.join(found, id_.eqNullSafe(F.col("__id")) & (F.xxhash64(body) == F.col("__row")), "left")
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("[TERM]" if generalise else ""))
    # where findings overlap, the text up to the furthest end so far is covered
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate("__found", start, lambda a, x: F.struct(F.when(x["start"] >= a["at"], F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.get(labels, x["kind"]))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["end"]).alias("at")), lambda a: F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), F.lit(2147483647))))
    clean = F.when(F.col("__found").isNull(), body).otherwise(cut)
    return joined.select(*[(clean if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])


def _of_kind(k: int):
    return lambda x: x["kind"] == k


def op8_sanitise(spark, sf_dir: str) -> DataFrame:
    rows = findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
