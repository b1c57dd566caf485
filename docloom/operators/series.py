"""Bucketing, densifying and filling."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fn
from ..functions.core import column
from ..sources.scratch import stash

#: Preferred-number series, in one decade (fixed values of the public standards; those of IEC 60063 and ISO 3).
SERIES = {
    "R5": [10, 16, 25, 40, 63],
    "R10": [100, 125, 160, 200, 250, 315, 400, 500, 630, 800],
    "R20": [100, 112, 125, 140, 160, 180, 200, 224, 250, 280, 315, 355, 400, 450, 500, 560, 630, 710, 800, 900],
    "R40": [100, 106, 112, 118, 125, 132, 140, 150, 160, 170, 180, 190, 200, 212, 224, 236, 250, 265, 280, 300, 315, 335, 355, 375, 400, 425, 450, 475, 500, 530, 560, 600, 630, 670, 710, 750, 800, 850, 900, 950],
    "R80": [100, 103, 106, 109, 112, 115, 118, 122, 125, 128, 132, 136, 140, 145, 150, 155, 160, 165, 170, 175, 180, 185, 190, 195, 200, 206, 212, 218, 224, 230, 236, 243, 250, 258, 265, 272, 280, 290, 300, 307,
            315, 325, 335, 345, 355, 365, 375, 387, 400, 412, 425, 437, 450, 462, 475, 487, 500, 515, 530, 545, 560, 580, 600, 615, 630, 650, 670, 690, 710, 730, 750, 775, 800, 825, 850, 875, 900, 925, 950, 975],
    "1-2-5": [10, 20, 50],
    "E6": [10, 15, 22, 33, 47, 68],
    "E12": [10, 12, 15, 18, 22, 27, 33, 39, 47, 56, 68, 82],
    "E24": [10, 11, 12, 13, 15, 16, 18, 20, 22, 24, 27, 30, 33, 36, 39, 43, 47, 51, 56, 62, 68, 75, 82, 91],
}


def series(name: str) -> list[float]:
    """Values of one decade from 1; the finer series follow their rule."""
    if name in SERIES:
        low = SERIES[name][0]
        return [x / low for x in SERIES[name]]
    if name in ("E48", "E96", "E192"):
        n = int(name[1:])
        out = [round(10 ** (i / n), 2) for i in range(n)]
        return [9.2 if x == 9.19 and n == 192 else x for x in out]
    raise ValueError(f"unknown granularity {name!r}")


def granular(value: Column, name: str, up: bool) -> Column:
    """The next number of a series above (up) or below a bound, not equal to it."""
    v = value.cast("double")
    if name == "POWERSOF2":
        e = F.log2(v)
        near = F.round(e)
        e = F.when(F.abs(e - near) < 1e-9, near).otherwise(e)
        out = F.pow(F.lit(2.0), F.floor(e) + 1 if up else F.ceil(e) - 1)
    else:
        decade = F.pow(F.lit(10.0), F.floor(F.log10(v)))
        own = F.array(*(F.lit(x * scale) for scale in (0.1, 1.0, 10.0) for x in series(name)))
        every = F.transform(own, lambda x: F.round(x * decade, 12))
        out = F.array_min(F.filter(every, lambda x: x > v * (1 + 1e-12))) if up else F.array_max(F.filter(every, lambda x: x < v * (1 - 1e-12)))
    return F.when(v == 0, F.lit(0.0)).otherwise(out)


def bucket_auto(df: DataFrame, key: Column, buckets: int, output: dict[str, Column], granularity: str | None = None) -> DataFrame:
    """Buckets of about equal count; equal keys stay together; max is the next bucket's min, the last one's its largest key.

    Only the counts of distinct keys are ranked, and the bucket of a key follows from the rows before it.
    """
    own = df.withColumn("__key", key)
    counts = own.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    spread = stash(counts.repartitionByRange("__key").withColumn("__p", F.spark_partition_id()), "ranges")  # both sides read the same numbers
    before = spread.groupBy("__p").agg(F.sum("__n").alias("__m")).withColumn("__from", F.coalesce(F.sum("__m").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = spread.agg(F.sum("__n").alias("__total"))
    w = W.partitionBy("__p").orderBy("__key").rowsBetween(W.unboundedPreceding, -1)
    at = spread.join(F.broadcast(before.select("__p", "__from")), "__p").crossJoin(F.broadcast(total))  # one row a partition, one row
    at = at.withColumn("__before", F.col("__from") + F.coalesce(F.sum("__n").over(w), F.lit(0)))
    size = F.greatest(F.round(F.col("__total") / buckets), F.lit(1))
    at = at.select("__key", F.least(F.floor(F.col("__before") / size), F.lit(buckets - 1)).cast("int").alias("__bucket"))
    named = own.join(at, own["__key"].eqNullSafe(at["__key"])).drop(at["__key"])
    out = named.groupBy("__bucket").agg(F.min("__key").alias("__min"), F.max("__key").alias("__max"), *(v.alias(k) for k, v in output.items()))
    w = W.orderBy("__bucket")  # `buckets` rows
    high = F.coalesce(F.lead("__min").over(w), F.col("__max"))
    out = out.withColumn("__high", high)
    low, high = F.col("__min"), F.col("__high")
    if granularity:
        up, low = granular(F.col("__min"), granularity, True), granular(F.col("__min"), granularity, False)
        high = F.coalesce(F.lead(up).over(w), granular(F.col("__max"), granularity, True))
        low = F.when(F.row_number().over(w) == 1, low).otherwise(up)
    return out.select(F.struct(low.alias("min"), high.alias("max")).alias("_id"), *output, "__bucket").orderBy("__bucket").drop("__bucket")


def densify(df: DataFrame, field: str, step: float, unit: str | None = None, bounds: Any = "full", by: list[str] | None = None) -> DataFrame:
    """Adds rows at missing points of field, from each partition's (or the whole frame's) least to its largest value, or in [low, high)."""
    by = by or []
    col, kind = column(field), df.schema[field].dataType
    dates = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
    if dates and not unit:
        raise ValueError("a date field needs a unit")
    parts = df.where(col.isNotNull()).groupBy(*by).agg(F.min(col).alias("__low"), F.max(col).alias("__high"))
    if bounds == "full":
        whole = df.agg(F.min(col).alias("__low"), F.max(col).alias("__high"))
        parts = parts.select(*by).crossJoin(F.broadcast(whole)) if by else whole  # one row
    elif bounds != "partition":
        parts = parts.select(*by, fn.c(bounds[0]).cast(kind).alias("__low"), fn.c(bounds[1]).cast(kind).alias("__high"))
    parts = parts.where("__low is not null")
    if dates:
        every = F.expr(f"interval {int(step)} {unit}") if unit != "millisecond" else F.make_dt_interval(secs=F.lit(step / 1000))
        points = F.sequence("__low", "__high", every)
    elif isinstance(kind, T.IntegralType) and float(step).is_integer():
        points = F.sequence(F.col("__low"), F.col("__high"), F.lit(int(step)).cast(kind))
    else:
        n = F.floor((F.col("__high") - F.col("__low")) / step + 1e-9).cast("int")
        points = F.transform(F.sequence(F.lit(0), n), lambda i: F.col("__low") + i * step)
    made = parts.select(*by, "__high", F.explode(points).alias("__point")).withColumn(field, F.col("__point").cast(kind)).drop("__point")
    if bounds not in ("full", "partition"):
        made = made.where(F.col(field) < F.col("__high"))
    made = made.select(*by, field)
    have = df.select(*by, field).distinct()
    same = [made[c].eqNullSafe(have[c]) for c in (*by, field)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return df.unionByName(made.join(have, cond, "left_anti"), allowMissingColumns=True).select(*df.columns)
