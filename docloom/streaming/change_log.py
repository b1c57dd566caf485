"""Change streams over a log of changes: rows (op, ts, key, before, after) in an append-only folder.

watch() reads the log as a stream; the checkpoint of the query that consumes it is the resume token. Stateless stages
(match, project, addFields, ...) reshape the events.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_schema(document: T.StructType, key: str = "_id") -> T.StructType:
    return T.StructType([T.StructField("op", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("key", document[key].dataType), T.StructField("before", document), T.StructField("after", document)])


def update_description(before: Column, after: Column, document: T.StructType) -> Column:
    """Names of updated and removed fields, and arrays that were only made shorter."""
    updated, removed, cut = [], [], []
    for f in document.fields:
        b, a = before[f.name], after[f.name]
        if isinstance(f.dataType, T.MapType):
            continue
        name = F.lit(f.name)
        shorter = F.lit(False)
        if isinstance(f.dataType, T.ArrayType):
            shorter = F.coalesce((F.size(a) < F.size(b)) & (F.slice(b, F.lit(1), F.size(a)) == a), F.lit(False))
            cut.append(F.when(shorter, F.struct(name.alias("field"), F.size(a).alias("newSize"))))
        updated.append(F.when(~a.eqNullSafe(b) & a.isNotNull() & ~shorter, name))
        removed.append(F.when(a.isNull() & b.isNotNull(), name))
    known = lambda xs, kind: F.filter(F.array(*xs), lambda x: x.isNotNull()) if xs else F.array().cast(kind)
    return F.struct(known(updated, "array<string>").alias("updatedFields"), known(removed, "array<string>").alias("removedFields"), known(cut, "array<struct<field:string,newSize:int>>").alias("truncatedArrays"))


def shape_events(log: DataFrame, full_document: str = "default", full_document_before_change: str = "off", hidden: list[str] = (), start_at: Any = None, **_: Any) -> DataFrame:
    """Change events. full_document: default (inserts and replacements), updateLookup, required or whenAvailable."""
    document = log.schema["after"].dataType
    after, before = F.col("after"), F.col("before")
    description = F.when(F.col("op") == "update", update_description(before, after, document)).alias("updateDescription")
    for h in hidden:
        after, before = after.dropFields(h), before.dropFields(h)
    shown = F.when(F.col("op").isin("insert", "replace") | F.lit(full_document != "default"), after)
    if start_at is not None:
        log = log.where(F.col("ts") >= F.lit(start_at))
    cols = [F.col("op").alias("operationType"), F.col("ts").alias("wallTime"), F.struct(F.col("key").alias("_id")).alias("documentKey"), shown.alias("fullDocument"), description]
    if full_document_before_change != "off":
        cols.append(before.alias("fullDocumentBeforeChange"))
    return log.select(*cols)


def watch(spark: SparkSession, path: str, document: T.StructType, key: str = "_id", build: Callable | None = None, max_files_per_trigger: int | None = None, **options: Any) -> DataFrame:
    """A streaming frame of change events; build reshapes them with stateless stages."""
    from ..operators.pipeline import Pipeline

    reader = spark.readStream.schema(log_schema(document, key))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = shape_events(reader.parquet(path), **options)
    return build(Pipeline.watch(events)).df if build else events


def apply_changes(collection: DataFrame, log: DataFrame, key: str = "_id") -> DataFrame:
    """The collection after all changes of a log: the last change of each key wins."""
    latest = log.groupBy("key").agg(F.max_by(F.struct("op", "after"), F.col("ts")).alias("last"))
    kept = collection.join(latest, collection[key].eqNullSafe(latest["key"]), "left_anti")
    fresh = latest.where(F.col("last.op") != "delete").select("last.after.*")
    return kept.unionByName(fresh.select(*collection.columns))


def tumbling(events: DataFrame, time: str, size: str, late: str, *aggregates: Column) -> DataFrame:
    """Windowed aggregates of a stream with a watermark; an extra."""
    return events.withWatermark(time, late).groupBy(F.window(time, size)).agg(*aggregates)
