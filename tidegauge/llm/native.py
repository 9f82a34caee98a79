"""Column helpers for operators that stay with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths that are summed at once for offsets.
STRIDE = 64


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def words(text: Column) -> Column:
    """The words of a text without null."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, in code points; the pattern never matches nothing.

    Offsets are sums of the lengths between and of matches, by strides and strides of strides so that many matches stay cheap.
    """

    def located(found: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))

        def summed(steps: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STRIDE).cast("int")), lambda b: total(F.slice(steps, b * STRIDE + 1, F.lit(STRIDE))))

        def before(steps: Column, k: Column) -> Column:
            return total(F.slice(steps, (F.floor(k / STRIDE) * STRIDE + 1).cast("int"), (k % STRIDE).cast("int")))

        def placed(steps: Column, strides: Column, far: Column) -> Column:
            return F.transform(
                found,
                lambda m, k: let(
                    total(F.slice(far, F.lit(1), F.floor(k / STRIDE**2).cast("int"))) + before(strides, F.floor(k / STRIDE)) + before(steps, k) + F.length(F.element_at(gaps, k + 1)),
                    lambda at: F.struct(at.cast("long").alias("start"), (at + F.length(m)).cast("long").alias("end"), m.alias("value")),
                ),
            )

        return let(steps, lambda steps: let(summed(steps), lambda strides: let(summed(strides), lambda far: placed(steps, strides, far))))

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda gaps: located(found, gaps))))
