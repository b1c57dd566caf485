"""Stored collections, views and materialised results. A write makes a new version beside the old one and then swaps."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import building, to_col


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def replace_collection(df: DataFrame, path: str, format: str = "parquet") -> DataFrame:
    """Writes df to a new folder beside path, then takes path's place: the old folder is renamed first and deleted last."""
    spark, mark = df.sparkSession, uuid.uuid4().hex
    fresh, old = f"{path.rstrip('/')}.{mark}", f"{path.rstrip('/')}.{mark}.old"
    df.write.format(format).save(fresh)
    fs, p = _fs(spark, path)
    had = fs.exists(p)
    if had:
        fs.rename(p, _fs(spark, old)[1])
    if not fs.rename(_fs(spark, fresh)[1], p):
        if had:
            fs.rename(_fs(spark, old)[1], p)
        raise OSError(f"can't put {fresh} in the place of {path}")
    if had:
        fs.delete(_fs(spark, old)[1], True)
    spark.catalog.refreshByPath(path)
    return spark.read.format(format).load(path)


def merged(old: DataFrame, new: DataFrame, on: list[str], when_matched: Any = "merge", when_not_matched: str = "insert") -> DataFrame:
    """The collection after an upsert of new rows, one row for each key in new.

    when_matched: replace, keepExisting, merge, fail, or a function (old fields, new fields) -> {column: value}.
    """
    if when_not_matched not in ("insert", "discard", "fail"):
        raise ValueError(f"unknown action {when_not_matched!r}")
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    left = old.select(*(F.col(f"`{c}`").alias(f"o_{c}") for c in old.columns), F.lit(True).alias("o_here"))
    right = new.select(*(F.col(f"`{c}`").alias(f"n_{c}") for c in new.columns), F.lit(True).alias("n_here"))
    cond = F.lit(True)
    for k in on:
        cond = cond & (F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")))
    both = left.join(right, cond, "full_outer")
    has_old, has_new = F.col("o_here").isNotNull(), F.col("n_here").isNotNull()
    if when_matched == "fail":
        both = both.where(F.when(has_old & has_new, F.raise_error(F.lit("a key is there already")).cast("boolean")).otherwise(True))
    if when_not_matched == "fail":
        both = both.where(F.when(~has_old & has_new, F.raise_error(F.lit("a key is missing")).cast("boolean")).otherwise(True))
    if when_not_matched == "discard":
        both = both.where(has_old)
    made: dict[str, Any] = {}
    if callable(when_matched):
        class Side:
            def __init__(self, mark: str):
                self.mark = mark

            def __getattr__(self, name: str) -> Any:
                return F.col(f"{self.mark}_{name}")

        with building(both):
            made = when_matched(Side("o"), Side("n"))
    out = []
    for c in columns:
        o = F.col(f"o_{c}") if c in old.columns else F.lit(None)
        n = F.col(f"n_{c}") if c in new.columns else F.lit(None)
        if callable(when_matched):
            value = to_col(made[c]) if c in made else o
        elif when_matched in ("keepExisting", "fail"):
            value = o
        elif when_matched == "replace":
            value = n
        elif when_matched == "merge":
            value = n if c in new.columns else o
        else:
            raise ValueError(f"unknown action {when_matched!r}")
        out.append(F.when(has_old & has_new, value).when(has_new, n).otherwise(o).alias(c))
    return both.select(*out)


def merge_into(df: DataFrame, path: str, on: list[str], when_matched: Any = "merge", when_not_matched: str = "insert") -> DataFrame:
    spark = df.sparkSession
    if not exists(spark, path):
        return replace_collection(df, path)
    return replace_collection(merged(spark.read.parquet(path), df, on, when_matched, when_not_matched), path)


class View:
    """A stored pipeline: a function from a pipeline over its source to a pipeline."""

    def __init__(self, name: str, build: Callable[[SparkSession], Any]):
        self.name, self.build = name, build

    def ensure(self, spark: SparkSession) -> DataFrame:
        df = self.build(spark).df
        df.createOrReplaceTempView(self.name)
        return df

    def drop(self, spark: SparkSession) -> None:
        spark.catalog.dropTempView(self.name)

    def query(self, spark: SparkSession, spec: Any = None) -> Any:
        """A find query over the view's rows: where, select, sort, count, distinct, ..."""
        from ..operators.query import Query

        out = Query(self.build(spark).df)
        return out if spec is None else out.where(spec)

    def find(self, spark: SparkSession, spec: Any = None) -> DataFrame:
        return self.query(spark, spec).df()

    def find_one(self, spark: SparkSession, spec: Any = None) -> DataFrame:
        return self.query(spark, spec).limit(1).df()

    def count(self, spark: SparkSession, spec: Any = None) -> int:
        return self.query(spark, spec).count()

    def distinct(self, spark: SparkSession, path: str, spec: Any = None) -> DataFrame:
        return self.query(spark, spec).distinct(path)

    def aggregate(self, spark: SparkSession, build: Callable[[Any], Any]) -> Any:
        return build(self.build(spark))


class Materialized:
    """A computed collection; refresh merges (default) or replaces. The key fields must be unique in the result."""

    def __init__(self, path: str, build: Callable[[SparkSession], Any], on: list[str], mode: str = "merge"):
        self.path, self.build, self.on, self.mode = path, build, on, mode

    def refresh(self, spark: SparkSession) -> DataFrame:
        df = self.build(spark).df
        if not df.groupBy(*self.on).count().where("count > 1").isEmpty():
            raise ValueError("the key fields are not unique")
        return replace_collection(df, self.path) if self.mode == "replace" else merge_into(df, self.path, self.on)
