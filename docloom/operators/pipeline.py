"""The pipeline: an immutable chain of stages over a frame. Every stage returns a new pipeline; nothing runs before a sink.

A pipeline remembers the keys of its last sort, which order-sensitive accumulators (first, push, ...) read. Without a
sort they use all columns, so results don't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fn
from ..functions.core import REMOVE, Acc, Fields, Order, Remove, building, column, directions, evaluate, to_col, type_of
from ..sources.scratch import stash
from . import search as _search
from . import series
from .filters import compile_filter, near_order
from .geo import distance_of, haversine

FIRST_ONLY = {"geoNear", "search", "searchMeta", "vectorSearch", "rankFusion", "scoreFusion", "collStats", "indexStats", "planCacheStats", "listSearchIndexes", "listSessions", "documents", "currentOp", "listLocalSessions", "queryStats", "listSampledQueries", "listClusterCatalog", "shardedDataDistribution", "querySettings", "changeStream"}
#: Stages that keep every row to itself.
NARROW = {"match", "project", "addFields", "set", "unset", "replaceRoot", "replaceWith", "redact", "unwind"}
UPDATE_STAGES = {"addFields", "set", "project", "unset", "replaceRoot", "replaceWith"}


class PipelineError(ValueError):
    pass


def _group_order(df: DataFrame, order: Order) -> Order:
    """The pipeline's order, then all sortable columns as ties."""
    if order:
        return order
    return [(F.col(f"`{f.name}`"), True) for f in df.schema.fields if isinstance(f.dataType, (T.AtomicType,)) and not f.name.startswith("__")]


def set_path(df: DataFrame, path: str, value: Any) -> DataFrame:
    """Writes a dotted path, through documents and arrays of documents; REMOVE drops it."""
    head, _, rest = path.partition(".")
    if not rest:
        return df.drop(head) if isinstance(value, Remove) else df.withColumn(head, to_col(value))
    if head not in df.columns:
        return df.withColumn(head, _nested(rest.split("."), value))
    return df.withColumn(head, _write(F.col(f"`{head}`"), df.schema[head].dataType, rest.split("."), value))


def _nested(parts: list[str], value: Any) -> Column:
    out = to_col(value)
    for p in reversed(parts):
        out = F.struct(out.alias(p))
    return out


def _write(here: Column, kind: T.DataType, parts: list[str], value: Any) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.transform(here, lambda x: _write(x, kind.elementType, parts, value))
    if isinstance(kind, T.MapType):
        key = F.lit(parts[0])
        rest = F.map_filter(here, lambda k, _: k != key)
        return rest if isinstance(value, Remove) else F.map_concat(rest, F.create_map(key, to_col(value)))
    if not isinstance(kind, T.StructType):
        return _nested(parts, value)
    head, rest = parts[0], parts[1:]
    if not rest:
        return here.dropFields(f"`{head}`") if isinstance(value, Remove) else F.coalesce(here.withField(f"`{head}`", to_col(value)), _fresh(kind, head, value))
    inner = _write(here[head], kind[head].dataType, rest, value) if head in kind.fieldNames() else _nested(rest, value)
    return here.withField(f"`{head}`", inner)


def _fresh(kind: T.StructType, name: str, value: Any) -> Column:
    own = [F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields if f.name != name]
    at = kind.fieldNames().index(name) if name in kind.fieldNames() else len(own)
    own.insert(at, to_col(value).alias(name))
    return F.struct(*own)


def include_paths(df: DataFrame, paths: list[str]) -> list[Column]:
    """Columns of the included dotted paths, documents rebuilt with only those fields."""
    tree: dict = {}
    for p in paths:
        here = tree
        for part in p.split("."):
            here = here.setdefault(part, {})

    def build(col: Column, kind: T.DataType, node: dict) -> Column:
        if not node:
            return col
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda x: build(x, kind.elementType, node))
        fields = [build(col[k], kind[k].dataType, n).alias(k) for k, n in node.items()]
        return F.when(col.isNotNull(), F.struct(*fields))

    return [build(F.col(f"`{k}`"), df.schema[k].dataType, n).alias(k) for k, n in tree.items()]


def frame(spec: dict | None, part: list[Column], order: Order, df: DataFrame) -> Any:
    """A window: the whole partition unless a frame is given."""
    w = W.partitionBy(*part)
    if order:
        w = w.orderBy(*(k.asc() if up else k.desc() for k, up in order))
    if not spec or not (spec.get("documents") or spec.get("range")):
        return w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    if spec.get("documents"):
        if not order:
            raise PipelineError("a documents frame needs sortBy")
        bound = lambda b, low: (W.unboundedPreceding if low else W.unboundedFollowing) if b == "unbounded" else 0 if b == "current" else int(b)
        a, b = spec["documents"]
        return w.rowsBetween(bound(a, True), bound(b, False))
    if len(order) != 1:
        raise PipelineError("a range frame needs one sort key")
    (key, up), unit = order[0], spec.get("unit")
    a, b = spec["range"]
    if unit:
        if unit not in fn.UNIT_MS:
            raise PipelineError("a range frame takes units of fixed length")
        key, scale = F.unix_millis(key.cast("timestamp")), fn.UNIT_MS[unit]
    else:
        scale = 1
    w = W.partitionBy(*part).orderBy(key.asc() if up else key.desc())
    bound = lambda x, low: (W.unboundedPreceding if low else W.unboundedFollowing) if x == "unbounded" else 0 if x == "current" else x * scale
    return w.rangeBetween(bound(a, True), bound(b, False))


def _at_ranks(df: DataFrame, name: str, at: float | list[float]) -> DataFrame:
    """Per __k the least values of __x with a share `at` of the group's values at or below them; equal values are one row before any order."""
    held = df.where(F.col("__x").isNotNull()).groupBy("__k", "__x").agg(F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy("__k")
    held = held.withColumn("__upto", F.sum("__n").over(w.orderBy("__x"))).withColumn("__all", F.sum("__n").over(w))
    low = lambda p: F.min(F.when(F.col("__upto") >= F.col("__all") * F.lit(Decimal(str(p))), F.col("__x")))
    return held.groupBy("__k").agg((F.array(*map(low, at)) if isinstance(at, (list, tuple)) else low(at)).alias(name))


@dataclass(frozen=True)
class Pipeline:
    df: DataFrame
    order: tuple = ()
    stages: tuple[str, ...] = ()
    mode: str = "collection"
    options: dict = field(default_factory=dict)

    # --- sources

    @classmethod
    def from_(cls, source: DataFrame, hidden: list[str] = (), include: list[str] = (), comment: str | None = None, **_: Any) -> Pipeline:
        """A collection. Hidden fields go unless included; hint, batchSize and the like have no meaning here."""
        if comment:
            source.sparkSession.sparkContext.setJobDescription(comment)
        return cls(source.drop(*(h for h in hidden if h not in include)))

    @classmethod
    def read(cls, spark: SparkSession, path: str, format: str = "parquet", **options: Any) -> Pipeline:
        return cls(spark.read.format(format).options(**options).load(path))

    @classmethod
    def database(cls, spark: SparkSession) -> Pipeline:
        return cls(spark.range(1).select(F.lit(None).cast("string").alias("_none")).limit(0), mode="database")

    admin = sessions = database

    @classmethod
    def update(cls, source: DataFrame) -> Pipeline:
        return cls(source, mode="update")

    @classmethod
    def watch(cls, events: DataFrame) -> Pipeline:
        return cls(events, mode="watch")

    def _next(self, stage: str, df: DataFrame, order: Any = ...) -> Pipeline:
        if self.stages and self.stages[-1] in ("out", "merge"):
            raise PipelineError(f"nothing may follow {self.stages[-1]}")
        if stage in FIRST_ONLY and self.stages:
            raise PipelineError(f"{stage} must be the first stage")
        if self.mode == "update" and stage not in UPDATE_STAGES:
            raise PipelineError(f"{stage} is no stage of an update")
        if self.mode == "facet" and (stage in FIRST_ONLY or stage in ("facet", "out", "merge")):
            raise PipelineError(f"{stage} can't stand in a facet")
        return replace(self, df=df, stages=(*self.stages, stage), order=self.order if order is ... else order)

    def _eval(self, spec: Any) -> Any:
        return evaluate(self.df, spec)

    def _keys(self) -> Order:
        return [(column(p), up) for p, up in self.order]

    # --- filters and order

    def match(self, spec: Any) -> Pipeline:
        out = self._next("match", self.df.where(compile_filter(self.df, spec)))
        if isinstance(spec, dict):
            with building(self.df):
                near = near_order(spec)
            if near is not None:
                return replace(out, df=out.df.orderBy(near))
        return out

    def sort(self, spec: Any) -> Pipeline:
        keys = []
        items = spec.items() if isinstance(spec, dict) else spec
        for path, d in items:
            keys.append((f"__meta_{d['$meta']}", False) if isinstance(d, dict) else directions([(path, d)])[0])
        if not keys:
            raise PipelineError("sort needs a key")
        return self._next("sort", self.df.orderBy(*(column(p).asc() if up else column(p).desc() for p, up in keys)), tuple(keys))

    def limit(self, n: int) -> Pipeline:
        if n < 1:
            raise PipelineError("limit must be positive")
        return self._next("limit", self.df.limit(n))

    def skip(self, n: int) -> Pipeline:
        if n < 0:
            raise PipelineError("skip must not be negative")
        return self._next("skip", self.df.offset(n))

    def sample(self, size: int, seed: int | None = None) -> Pipeline:
        if size < 1:
            raise PipelineError("sample needs a positive size")
        return self._next("sample", self.df.orderBy(F.rand(seed)).limit(size), ())

    def count(self, name: str) -> Pipeline:
        return self._next("count", self.df.agg(F.count(F.lit(1)).alias(name)).where(F.col(f"`{name}`") > 0), ())

    def redact(self, spec: Callable[[Fields], Any]) -> Pipeline:
        """KEEP, PRUNE or DESCEND; with DESCEND the verdict is taken anew in every subdocument that has the fields it reads."""
        verdict = to_col(self._eval(spec))
        top = self.df.where(verdict != "prune")
        fields = []
        for f in self.df.schema.fields:
            inner = self._redacted(spec, F.col(f"`{f.name}`"), f.dataType)
            fields.append((F.when(verdict == "descend", inner).otherwise(F.col(f"`{f.name}`")) if inner is not None else F.col(f"`{f.name}`")).alias(f.name))
        return self._next("redact", top.select(*fields))

    def _redacted(self, spec: Callable, here: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.ArrayType):
            if not isinstance(kind.elementType, T.StructType) or self._redacted(spec, here, kind.elementType) is None:
                return None
            kept = F.filter(here, lambda x: self._verdict(spec, x) != "prune")
            return F.transform(kept, lambda x: self._redacted(spec, x, kind.elementType))
        if not isinstance(kind, T.StructType):
            return None
        verdict = self._verdict(spec, here, kind)
        if verdict is None:
            return None
        fields = []
        for f in kind.fields:
            inner = self._redacted(spec, here[f.name], f.dataType)
            fields.append((here[f.name] if inner is None else inner).alias(f.name))
        return F.when(verdict == "keep", here).when(verdict == "descend", F.struct(*fields))

    def _verdict(self, spec: Callable, here: Column, kind: T.StructType | None = None) -> Column | None:
        used: list[str] = []

        class Inner(Fields):
            def __getattr__(self, name: str) -> Column:
                used.append(name)
                return here[name]

            def __getitem__(self, name: str) -> Column:
                used.append(name.split(".")[0])
                return here[name]

        with building(None):
            out = to_col(spec(Inner()))
        return None if kind is not None and not set(used) <= set(kind.fieldNames()) else out

    # --- shape

    def add_fields(self, spec: Any) -> Pipeline:
        own, df = self._eval(spec), self.df
        plain = {k: v for k, v in own.items() if "." not in k and not isinstance(v, Remove)}
        with building(df):
            cols = {k: to_col(v) for k, v in plain.items()}
        df = df.withColumns(cols) if cols else df
        for k, v in own.items():
            if k not in plain:
                with building(df):
                    df = set_path(df, k, v)
        return self._next("addFields", df)

    def set(self, spec: Any) -> Pipeline:
        return replace(self.add_fields(spec), stages=(*self.stages, "set"))

    def project(self, spec: Any) -> Pipeline:
        own = self._eval(spec)
        flags = {k: v for k, v in own.items() if v in (0, 1, True, False) and not isinstance(v, (Column, Acc))} if not any(isinstance(v, (Column, Acc)) for v in own.values()) else {k: v for k, v in own.items() if not isinstance(v, (Column, Acc)) and isinstance(v, int) and v in (0, 1)}
        out_ = [k for k, v in flags.items() if not v and k != "_id"]
        in_ = [k for k, v in flags.items() if v]
        made = {k: v for k, v in own.items() if k not in flags}
        if out_ and (in_ or made):
            raise PipelineError("include and exclude don't mix")
        df = self.df
        if out_ or (not in_ and not made):
            return self._next("project", self._dropped(df, out_ + (["_id"] if flags.get("_id") == 0 else [])))
        keep_id = "_id" in df.columns and flags.get("_id", 1) and "_id" not in in_ and "_id" not in made
        paths = (["_id"] if keep_id else []) + in_
        with building(df):
            cols = include_paths(df, paths)
            cols += [to_col(v).alias(k) for k, v in made.items() if "." not in k and not isinstance(v, Remove)]
        df2 = df.select(*cols)
        for k, v in made.items():
            if "." in k:
                raise PipelineError("computed dotted paths belong in addFields")
        return self._next("project", df2)

    @staticmethod
    def _dropped(df: DataFrame, paths: list[str]) -> DataFrame:
        for p in paths:
            df = set_path(df, p, REMOVE)
        return df

    def unset(self, paths: str | list[str]) -> Pipeline:
        return self._next("unset", self._dropped(self.df, [paths] if isinstance(paths, str) else list(paths)))

    def replace_root(self, spec: Any) -> Pipeline:
        with building(self.df):
            doc = self._eval(spec)
            doc = to_col(doc)
        whole = self.df.select(F.coalesce(doc, F.when(F.lit(True), F.raise_error(F.lit("the new root is null")))).alias("__root"))
        return self._next("replaceRoot", whole.select("__root.*"), ())

    def replace_with(self, spec: Any) -> Pipeline:
        return replace(self.replace_root(spec), stages=(*self.stages, "replaceWith"))

    def unwind(self, path: str, include_array_index: str | None = None, preserve_null_and_empty_arrays: bool = False) -> Pipeline:
        path = path.removeprefix("$")
        keep, index = preserve_null_and_empty_arrays, include_array_index
        df, col = self.df, column(path)
        if index:
            made = df.select("*", (F.posexplode_outer if keep else F.posexplode)(col).alias("__at", "__item"))
            made = made.withColumn(index, F.col("__at").cast("bigint")).drop("__at")
        else:
            made = df.select("*", (F.explode_outer if keep else F.explode)(col).alias("__item"))
        made = made.withColumn(path, F.col("__item")) if "." not in path else set_path(made, path, F.col("__item"))
        out = made.drop("__item")
        return self._next("unwind", out.select(*df.columns, *([index] if index and index not in df.columns else [])))

    # --- groups

    def _outputs(self, own: dict, df: DataFrame) -> dict[str, Column]:
        order = _group_order(df, self._keys())
        out = {}
        for k, v in own.items():
            if not isinstance(v, Acc) or v.over is None:
                raise PipelineError(f"{k!r} is no accumulator")
            out[k] = v.over(order).alias(k)
        return out

    def group(self, spec: Any) -> Pipeline:
        df = self.df
        own = dict(self._eval(spec))
        key = own.pop("_id")
        few = {k: v for k, v in own.items() if isinstance(v, Acc) and v.few and v.over}
        with building(df):
            outputs = self._outputs(own, df)
            col = F.lit(1) if key is None else to_col(key)
            bounds = {k: v.few[0](_group_order(df, self._keys())) for k, v in few.items()}
        ranked = {k: v.ranks for k, v in own.items() if v.ranks}
        rest = [v for k, v in outputs.items() if k not in few and k not in ranked]
        grouped = df.groupBy(col.alias("_id"))
        out = grouped.agg(*rest) if rest else grouped.agg(F.count(F.lit(1)).alias("__n")).drop("__n")
        for name, order in bounds.items():  # rows that can't be among the first n go before anything is gathered
            w = W.partitionBy("__k").orderBy(*(k.asc() if up else k.desc() for k, up in order))
            kept = df.withColumn("__k", F.struct(col.alias("k"))).withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= few[name].few[1])
            found = kept.groupBy("__k").agg(outputs[name])
            out = out.join(found, F.struct(F.col("_id").alias("k")) == F.col("__k"), "left").drop("__k")
        for name, (x, at) in ranked.items():
            found = _at_ranks(df.select(F.struct(col.alias("k")).alias("__k"), x.alias("__x")), name, at)
            out = out.join(found, F.struct(F.col("_id").alias("k")) == F.col("__k"), "left").drop("__k")
        if key is None:
            out = out.withColumn("_id", F.lit(None).cast("string"))
        return self._next("group", out.select("_id", *own), ())

    def bucket(self, group_by: Any, boundaries: list, default: Any = ..., output: Any = None) -> Pipeline:
        if len(boundaries) < 2 or any(not a < b for a, b in zip(boundaries, boundaries[1:], strict=False)):
            raise PipelineError("boundaries must rise")
        with building(self.df):
            x = to_col(self._eval(group_by))
            key = F
            for low, high in zip(boundaries, boundaries[1:], strict=False):
                key = key.when((x >= fn.c(low)) & (x < fn.c(high)), fn.c(low))
            key = key.otherwise(F.raise_error(F.lit("a value is in no bucket")) if default is ... else fn.c(default))
            outputs = self._outputs(self._eval(output or {"count": fn.count()}), self.df)
        out = self.df.groupBy(key.alias("_id")).agg(*outputs.values()).orderBy("_id")
        return self._next("bucket", out, (("_id", True),))

    def bucket_auto(self, group_by: Any, buckets: int, output: Any = None, granularity: str | None = None) -> Pipeline:
        with building(self.df):
            key = to_col(self._eval(group_by))
            outputs = self._outputs(self._eval(output or {"count": fn.count()}), self.df)
        return self._next("bucketAuto", series.bucket_auto(self.df, key, buckets, outputs, granularity), ())

    def sort_by_count(self, spec: Any) -> Pipeline:
        with building(self.df):
            key = to_col(self._eval(spec))
        out = self.df.groupBy(key.alias("_id")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc("_id"))
        return self._next("sortByCount", out, (("count", False), ("_id", True)))

    # --- windows and series

    def set_window_fields(self, output: Any, partition_by: Any = None, sort_by: Any = None) -> Pipeline:
        df = self.df
        with building(df):
            part = [] if partition_by is None else [to_col(self._eval(partition_by))]
            order = [(column(p), up) for p, up in directions(sort_by)] if sort_by else []
            cols, helpers = {}, []
            for name, acc in self._eval(output).items():
                if not isinstance(acc, Acc) or acc.framed is None:
                    raise PipelineError(f"{name!r} is no window function")
                if acc.needs_sort and not order:
                    raise PipelineError(f"{name!r} needs sortBy")
                if acc.single_key and len(order) != 1:
                    raise PipelineError(f"{name!r} needs one sort key")
                if acc.needs_frame and not acc.frame:
                    raise PipelineError(f"{name!r} needs a window")
                w = frame(acc.frame, part, order, df)
                mark = f"__{len(cols)}_"
                for step in acc.first:
                    made = step(order, part, mark)
                    helpers += made
                    df = df.withColumns(made)
                cols[name] = acc.framed(*(w, order, part, mark)[: acc.framed.__code__.co_argcount])
        return self._next("setWindowFields", df.withColumns(cols).drop(*helpers))

    def densify(self, field: str, step: float, unit: str | None = None, bounds: Any = "full", partition_by_fields: list[str] | None = None) -> Pipeline:
        return self._next("densify", series.densify(self.df, field, step, unit, bounds, partition_by_fields))

    def fill(self, output: dict, partition_by: Any = None, partition_by_fields: list[str] | None = None, sort_by: Any = None) -> Pipeline:
        df = self.df
        with building(df):
            part = [column(p) for p in partition_by_fields or []] + ([to_col(self._eval(partition_by))] if partition_by is not None else [])
            order = [(column(p), up) for p, up in directions(sort_by)] if sort_by else []
            own = self._eval(output) if callable(output) else output
            cols = {}
            for name, how in own.items():
                if "value" in how:
                    value = how["value"]
                    cols[name] = F.coalesce(column(name), to_col(self._eval(value)))
                else:
                    if not order:
                        raise PipelineError("a fill method needs sortBy")
                    acc = {"locf": fn.locf, "linear": fn.linear_fill}[how["method"]](column(name))
                    cols[name] = acc.framed(None, order, part)
        return self._next("fill", df.withColumns(cols))

    # --- joins and sets

    def lookup(self, as_: str, from_: DataFrame | list | None = None, local_field: str | None = None, foreign_field: str | None = None, let: Any = None, pipeline: Callable | None = None) -> Pipeline:
        """Left outer join, the matches as an array of documents in the order of all their columns, or the sub-pipeline's.

        let with a sub-pipeline: pairs {name: column of this side}; the sub-pipeline is a function (pipeline, outer) whose
        equality matches on outer values become join keys. Without a key the sub-pipeline's rows go to every document.
        """
        df = self.df
        if from_ is None:
            from_ = df.sparkSession.range(1).toDF("__one")
        right = literal_rows(df.sparkSession, from_) if isinstance(from_, list) else rows_of(from_)
        if local_field:
            sub = pipeline(Pipeline(right)) if pipeline and let is None else None
            own = sub.df if sub else right
            if foreign_field not in own.columns and "." not in foreign_field:
                raise PipelineError("the sub-pipeline must keep the foreign field")
            key = column(foreign_field)
            rows = own.groupBy(key.alias("__key")).agg(self._nested_rows(own, sub).alias("__rows"))
            return self._next("lookup", self._attach(df, column(local_field), rows, as_, own.schema))
        if pipeline is None:
            raise PipelineError("lookup needs fields or a pipeline")
        if let is None:
            sub = pipeline(Pipeline(right))
            rows = sub.df.agg(F.coalesce(self._nested_rows(sub.df, sub), F.array()).alias(as_))
            return self._next("lookup", df.crossJoin(F.broadcast(rows)))  # one row
        return self._next("lookup", self._correlated(df, right, as_, let, pipeline))

    def _nested_rows(self, own: DataFrame, sub: Pipeline | None) -> Column:
        cols = [F.col(f"`{n}`") for n in own.columns]
        doc = F.struct(*cols)
        if sub is not None and sub.order:
            with building(own):
                return fn.push(doc).over([*sub._keys(), *((F.col(f"`{n}`"), True) for n in own.columns)])
        try:
            return F.array_sort(F.collect_list(doc))
        except Exception:  # documents with maps have no order
            return F.collect_list(doc)

    def _attach(self, df: DataFrame, local: Column, rows: DataFrame, as_: str, schema: T.StructType) -> DataFrame:
        kind = df.select(local.alias("x")).schema[0].dataType
        empty = F.array().cast(T.ArrayType(T.StructType(schema.fields)))
        if isinstance(kind, T.ArrayType):  # any element may match
            own = df.withColumn("__list", local).withColumn("__id", list_id("__list"))  # equal lists are looked up once
            keys = own.where("__list is not null").select("__id", "__list").dropDuplicates(["__id"]).select("__id", F.explode(F.array_distinct("__list")).alias("__local"))
            found = keys.join(rows, F.col("__local").eqNullSafe(F.col("__key"))).groupBy("__id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__rows")))).alias("__rows"))
            out = own.join(found, "__id", "left").select(*(F.col(f"`{c}`") for c in df.columns), "__rows")
        else:
            out = df.withColumn("__local", local).join(rows, F.col("__local").eqNullSafe(F.col("__key")), "left").drop("__key", "__local")
        return out.withColumn("__rows", F.coalesce("__rows", empty)).withColumn(as_, F.col("__rows")).drop("__rows") if "." not in as_ else set_path(out.withColumn("__rows", F.coalesce("__rows", empty)), as_, F.col("__rows")).drop("__rows")

    def _correlated(self, df: DataFrame, right: DataFrame, as_: str, let: dict, pipeline: Callable) -> DataFrame:
        """Each distinct combination of outer values is joined once with the rows that meet the first match."""
        with building(df):
            own = evaluate(df, let)
            outer = df.withColumns({f"__let_{k}": to_col(v) for k, v in own.items()})
        names = [f"__let_{k}" for k in own]
        values = outer.select(*names).distinct()
        sub = Correlated(values, right, names)
        out: Pipeline = pipeline(sub, Outer())
        out = out.finish() if isinstance(out, Correlated) else out
        docs = out.df
        cols = [c for c in docs.columns if c not in names]
        order = [(p, up) for p, up in out.order if p in cols]
        with building(docs):
            doc = F.struct(*(F.col(f"`{c}`") for c in cols))
            rows = fn.push(doc).over([(column(p), up) for p, up in order] + [(F.col(f"`{c}`"), True) for c in cols])
        rows = docs.groupBy(*names).agg(rows.alias(as_))
        cond = F.lit(True)
        left = outer.alias("l")
        right_ = rows.select(*(F.col(n).alias(f"{n}_r") for n in names), as_)
        for n in names:
            cond = cond & F.col(f"l.{n}").eqNullSafe(F.col(f"{n}_r"))
        joined = left.join(right_, cond, "left").drop(*(f"{n}_r" for n in names), *names)
        empty = F.array().cast(T.ArrayType(T.StructType([docs.schema[c] for c in cols])))
        return joined.withColumn(as_, F.coalesce(as_, empty))

    def lookup_unwind(self, from_: DataFrame, local_field: str, foreign_field: str, as_: str, preserve_null_and_empty_arrays: bool = False) -> Pipeline:
        """lookup and unwind in one: a plain join, nothing is nested."""
        from_ = rows_of(from_)
        right = from_.select(column(foreign_field).alias("__key"), F.struct(*(F.col(f"`{n}`") for n in from_.columns)).alias(as_))
        how = "left" if preserve_null_and_empty_arrays else "inner"
        out = self.df.join(right, column(local_field).eqNullSafe(F.col("__key")), how).drop("__key")
        return replace(self._next("lookup", out), stages=(*self.stages, "lookup", "unwind"))

    def lookup_exists(self, from_: Any, local_field: str, foreign_field: str, missing: bool = False) -> Pipeline:
        """The documents that have a match (a semi join), or none (missing: an anti join); null matches null, as in lookup."""
        right = rows_of(from_).select(column(foreign_field).alias("__key"))
        return self._next("lookup", self.df.join(right, column(local_field).eqNullSafe(F.col("__key")), "left_anti" if missing else "left_semi"))

    def graph_lookup(self, from_: DataFrame, start_with: Any, connect_from_field: str, connect_to_field: str, as_: str, max_depth: int | None = None, depth_field: str | None = None, restrict_search_with_match: Any = None) -> Pipeline:
        """Nodes reachable from start_with, each once with its least depth. One join a level; cycles end by the visited set.

        A level is narrow pairs of a start and a node, written and read back; documents are joined to them at the end.
        """
        df, from_ = self.df, rows_of(from_)
        edges = from_ if restrict_search_with_match is None else from_.where(compile_filter(from_, restrict_search_with_match))
        with building(df):
            own = df.withColumn("__start", to_col(self._eval(start_with)))
        kind = own.schema["__start"].dataType
        starts = own.select("__start").distinct()
        front = starts.select(F.col("__start"), (F.explode("__start") if isinstance(kind, T.ArrayType) else F.col("__start")).alias("__at")).where("__at is not null")
        nodes = edges.select(column(connect_to_field).alias("__to"), column(connect_from_field).alias("__from"), F.struct(*(F.col(f"`{n}`") for n in edges.columns)).alias("__doc"))
        many = isinstance(nodes.schema["__from"].dataType, T.ArrayType)
        links = nodes.where("__to is not null").select("__to", (F.explode("__from") if many else F.col("__from")).alias("__next")).distinct()
        keys = nodes.where("__to is not null").select(F.col("__to").alias("__at")).distinct()
        seen, depth = None, 0
        while True:
            found = front.join(keys, "__at", "left_semi").select("__start", F.lit(depth).cast("bigint").alias("__depth"), F.col("__at").alias("__to")).distinct()
            if seen is not None:
                found = found.join(seen.select(F.col("__start").alias("__s"), F.col("__to").alias("__t")), F.col("__start").eqNullSafe(F.col("__s")) & (F.col("__to") == F.col("__t")), "left_anti")
            found = stash(found, "level")
            if found.isEmpty():
                break
            seen = found if seen is None else seen.unionByName(found)
            if max_depth is not None and depth >= max_depth:
                break
            front = found.join(links, "__to").where("__next is not null").select("__start", F.col("__next").alias("__at"))
            depth += 1
        doc_type = nodes.schema["__doc"].dataType
        doc = F.col("__doc").withField(depth_field, F.col("__depth")) if depth_field else F.col("__doc")
        element = T.StructType([*doc_type.fields, T.StructField(depth_field, T.LongType())]) if depth_field else doc_type
        empty = F.array().cast(T.ArrayType(element))
        if seen is None:
            return self._next("graphLookup", df.withColumn(as_, empty))
        seen = seen.join(nodes.select("__to", "__doc"), "__to")
        rows = seen.groupBy(F.col("__start").alias("__s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__depth", doc.alias("d")))), lambda x: x["d"]).alias(as_))
        out = own.join(rows, F.col("__start").eqNullSafe(F.col("__s")), "left").drop("__s", "__start").withColumn(as_, F.coalesce(as_, empty))
        return self._next("graphLookup", out)

    def union_with(self, other: DataFrame | Pipeline | list, pipeline: Callable | None = None) -> Pipeline:
        own = literal_rows(self.df.sparkSession, other) if isinstance(other, list) else rows_of(other)
        if pipeline:
            own = pipeline(Pipeline(own)).df
        return self._next("unionWith", self.df.unionByName(own, allowMissingColumns=True), ())

    def facet(self, branches: dict[str, Callable[[Pipeline], Pipeline]]) -> Pipeline:
        """One row with an array for each branch. Behind stages that only filter and shape rows, each branch reads the
        source for itself, with its own columns and filters; any other input is written once and read by all."""
        shared = self.df if set(self.stages) <= NARROW else stash(self.df, "facet")
        out = None
        for name, branch in branches.items():
            own = branch(replace(self, df=shared, mode="facet"))
            if len(own.stages) == len(self.stages):
                raise PipelineError("an empty facet branch")
            with building(own.df):
                rows = self._nested_rows(own.df, own if own.order and all(p in own.df.columns for p, _ in own.order) else None)
            one = own.df.agg(F.coalesce(rows, F.array()).alias(name))
            out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
        return self._next("facet", out, ())

    # --- search

    def geo_near(self, near: Any, distance_field: str, key: str, query: Any = None, spherical: bool = True, min_distance: float | None = None, max_distance: float | None = None, distance_multiplier: float = 1.0, include_locs: str | None = None) -> Pipeline:
        self._next("geoNear", self.df)
        df = self.df if query is None else self.df.where(compile_filter(self.df, query))
        with building(df):
            raw = haversine(column(key), near) if spherical else distance_of(column(key), near["coordinates"] if isinstance(near, dict) else near)
        df = df.withColumn("__raw", raw).where("__raw is not null")
        if min_distance is not None:
            df = df.where(F.col("__raw") >= float(min_distance))
        if max_distance is not None:
            df = df.where(F.col("__raw") <= float(max_distance))
        df = df.withColumn("__meta_geoNearDistance", F.col("__raw") * distance_multiplier)
        df = set_path(df, distance_field, F.col("__meta_geoNearDistance"))
        if include_locs:
            df = set_path(df, include_locs, column(key))
        return self._next("geoNear", df.drop("__raw").orderBy("__meta_geoNearDistance"), (("__meta_geoNearDistance", True),))

    def search(self, spec: dict) -> Pipeline:
        return self._next("search", _search.search(self.df, spec).orderBy(F.desc("__meta_searchScore")), (("__meta_searchScore", False),))

    def search_meta(self, spec: dict) -> Pipeline:
        return self._next("searchMeta", _search.search_meta(self.df, spec), ())

    def vector_search(self, path: str, query_vector: list[float], limit: int, similarity: str = "cosine", filter: Any = None, id_col: str | None = None, **_: Any) -> Pipeline:
        found = _search.vector_search(self.df, path, query_vector, limit, similarity, filter, id_col)
        return self._next("vectorSearch", found, (("__meta_vectorSearchScore", False), *([(id_col, True)] if id_col else [])))

    def rank_fusion(self, pipelines: dict[str, Callable[[Pipeline], Pipeline]], key: str, weights: dict[str, float] | None = None) -> Pipeline:
        """Each branch must end sorted and limited: its ranks are numbered in one task."""
        branches = {}
        for name, branch in pipelines.items():
            own = branch(Pipeline(self.df))
            if not own.order:
                raise PipelineError("a ranked branch needs an order")
            w = W.orderBy(*(column(p).asc() if up else column(p).desc() for p, up in own.order))
            branches[name] = own.df.withColumn("__rank", F.row_number().over(w)).drop(*(c for c in own.df.columns if c.startswith("__meta_")))
        return self._next("rankFusion", _search.rank_fusion(branches, key, weights), (("__meta_score", False), (key, True)))

    def score_fusion(self, pipelines: dict[str, Callable[[Pipeline], Pipeline]], key: str, normalization: str = "none", weights: dict[str, float] | None = None) -> Pipeline:
        """Weighted mean of the branches' normalised scores; a row missing from a branch has 0 there."""
        parts, total = None, 0.0
        for name, branch in pipelines.items():
            own = branch(Pipeline(self.df)).df
            score = next((c for c in own.columns if c.startswith("__meta_")), None)
            if score is None:
                raise PipelineError("a scored branch needs a score")
            weight = float((weights or {}).get(name, 1.0))
            total += 1.0
            own = _search.scaled(own, F.col(score), normalization, "__part").withColumn("__part", F.col("__part") * weight).drop(*(c for c in own.columns if c.startswith("__meta_")))
            parts = own if parts is None else parts.unionByName(own, allowMissingColumns=True)
        rest = [c for c in parts.columns if c not in (key, "__part")]
        out = parts.groupBy(key).agg(*(F.first(c, ignorenulls=True).alias(c) for c in rest), (F.sum("__part") / total).alias("__meta_score"))
        return self._next("scoreFusion", out.orderBy(F.desc("__meta_score"), key), (("__meta_score", False), (key, True)))

    def score(self, score: Any, normalization: str = "none", weight: float = 1.0) -> Pipeline:
        with building(self.df):
            value = to_col(self._eval(score))
        out = _search.scaled(self.df, value, normalization, "__meta_score")
        return self._next("score", out.withColumn("__meta_score", F.col("__meta_score") * weight))

    # --- system

    def coll_stats(self, **_: Any) -> Pipeline:
        files = self.df.inputFiles()
        return self._next("collStats", self.df.agg(F.count(F.lit(1)).alias("count")).withColumn("files", F.lit(len(files))), ())

    def _empty(self, stage: str, schema: str) -> Pipeline:
        return self._next(stage, self.df.sparkSession.createDataFrame([], schema), ())

    def index_stats(self) -> Pipeline:
        return self._empty("indexStats", "name string, key string, accesses bigint")

    def plan_cache_stats(self, **_: Any) -> Pipeline:
        return self._empty("planCacheStats", "planCacheKey string, works bigint")

    def list_search_indexes(self, **_: Any) -> Pipeline:
        return self._empty("listSearchIndexes", "id string, name string, status string")

    def list_sessions(self, **_: Any) -> Pipeline:
        spark = self.df.sparkSession
        return self._next("listSessions", spark.range(1).select(F.lit(spark.sparkContext.applicationId).alias("_id"), F.current_user().alias("user")), ())

    def list_local_sessions(self, **_: Any) -> Pipeline:
        return replace(self.list_sessions(), stages=(*self.stages, "listLocalSessions"))

    def documents(self, rows: list[dict], schema: Any = None) -> Pipeline:
        return self._next("documents", literal_rows(self.df.sparkSession, rows, schema), ())

    def current_op(self, **_: Any) -> Pipeline:
        spark = self.df.sparkSession
        ids = list(spark.sparkContext.statusTracker().getActiveJobsIds())
        return self._next("currentOp", spark.createDataFrame([(i,) for i in ids], "opid int"), ())

    def query_stats(self, **_: Any) -> Pipeline:
        return self._empty("queryStats", "key string, metrics string")

    def list_sampled_queries(self, **_: Any) -> Pipeline:
        return self._empty("listSampledQueries", "ns string, query string")

    def list_cluster_catalog(self, **_: Any) -> Pipeline:
        spark = self.df.sparkSession
        rows = [(t.name, t.database if hasattr(t, "database") else None, t.tableType) for t in spark.catalog.listTables()]
        return self._next("listClusterCatalog", spark.createDataFrame(rows, "name string, db string, type string"), ())

    def sharded_data_distribution(self) -> Pipeline:
        out = self.df.groupBy(F.spark_partition_id().alias("shard")).agg(F.count(F.lit(1)).alias("numOwnedDocuments"))
        return self._next("shardedDataDistribution", out, ())

    def query_settings(self, **_: Any) -> Pipeline:
        return self._empty("querySettings", "queryShapeHash string, settings string")

    def change_stream(self, **options: Any) -> Pipeline:
        from ..streaming.change_log import shape_events

        return self._next("changeStream", shape_events(self.df, **options), ())

    def change_stream_split_large_event(self) -> Pipeline:
        return self._next("changeStreamSplitLargeEvent", self.df)

    # --- sinks

    def out(self, target: str, format: str = "parquet") -> DataFrame:
        from ..sources.collections import replace_collection

        self._next("out", self.df)
        return replace_collection(self.df, target, format)

    def merge(self, into: str, on: str | list[str] = "_id", when_matched: Any = "merge", when_not_matched: str = "insert") -> DataFrame:
        from ..sources.collections import merge_into

        self._next("merge", self.df)
        return merge_into(self.df, into, [on] if isinstance(on, str) else list(on), when_matched, when_not_matched)

    # --- results

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def cursor(self) -> Any:
        return self.df.toLocalIterator()

    def exec(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.df.collect()]

    def plain(self) -> DataFrame:
        """JSON-safe values: 64-bit and decimal numbers and dates as strings."""
        cols = []
        for f in self.df.schema.fields:
            c = F.col(f"`{f.name}`")
            safe = isinstance(f.dataType, (T.LongType, T.DecimalType, T.TimestampType, T.TimestampNTZType))
            with building(self.df):
                cols.append((fn.to_string(c) if safe else c).alias(f.name))
        return self.df.select(*cols)

    def mask(self, rules: dict[str, Any]) -> DataFrame:
        """rules: path -> "hash", "redact" or a function of the column."""
        df = self.df
        for path, rule in rules.items():
            c = column(path)
            value = F.sha2(c.cast("string"), 256) if rule == "hash" else F.when(c.isNotNull(), F.lit("***")) if rule == "redact" else rule(c)
            df = set_path(df, path, value)
        return df

    def parse(self, schema: T.StructType) -> DataFrame:
        """Fails where the rows have not the expected columns and types."""
        got = {f.name: f.dataType for f in self.df.schema.fields}
        for f in schema.fields:
            if got.get(f.name) != f.dataType:
                raise PipelineError(f"{f.name} is {got.get(f.name)}, not {f.dataType}")
        return self.df.select(*schema.fieldNames())


def rows_of(source: Any) -> DataFrame:
    """The rows of a frame, a pipeline, or a collection; a collection's come scoped by its own policies."""
    return source if isinstance(source, DataFrame) else source.scoped() if hasattr(source, "scoped") else source.df


def list_id(name: str) -> Column:
    """Two 64-bit hashes of a list, in place of the list as a key."""
    return F.struct(F.xxhash64(name).alias("a"), F.xxhash64(F.lit(7), F.col(name)).alias("b"))


def literal_rows(spark: SparkSession, rows: list[dict], schema: Any = None) -> DataFrame:
    return spark.createDataFrame(rows, schema) if schema is not None or rows else spark.range(0).select(F.lit(None).cast("string").alias("_id"))


class Outer:
    """Outer values in a correlated sub-pipeline: outer.name."""

    def __getattr__(self, name: str) -> Column:
        return F.col(f"__let_{name}")


class Correlated:
    """A sub-pipeline that waits for its first match, whose condition joins outer values with inner rows."""

    def __init__(self, values: DataFrame, right: DataFrame, names: list[str]):
        self.values, self.right, self.names = values, right, names

    def match(self, spec: Callable[[Fields], Any]) -> CorrelatedRest:
        with building(None):
            cond = to_col(spec(Fields())) if callable(spec) else compile_filter(self.right, spec)
        return CorrelatedRest(Pipeline(self.values.join(self.right, cond)), self.names)

    def finish(self) -> Pipeline:
        return Pipeline(self.values.crossJoin(self.right))


class CorrelatedRest:
    """The stages behind the match, each within one combination of outer values."""

    def __init__(self, pipe: Pipeline, names: list[str]):
        self.pipe, self.names = pipe, names

    @property
    def df(self) -> DataFrame:
        return self.pipe.df

    @property
    def order(self) -> tuple:
        return self.pipe.order

    def _with(self, pipe: Pipeline) -> CorrelatedRest:
        return CorrelatedRest(pipe, self.names)

    def match(self, spec: Any) -> CorrelatedRest:
        return self._with(self.pipe.match(spec))

    def sort(self, spec: Any) -> CorrelatedRest:
        keys = tuple(directions(spec))
        return self._with(replace(self.pipe, order=keys))

    def limit(self, n: int) -> CorrelatedRest:
        w = W.partitionBy(*self.names).orderBy(*(column(p).asc() if up else column(p).desc() for p, up in self.pipe.order) or [F.lit(1)])
        return self._with(replace(self.pipe, df=self.pipe.df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")))

    def add_fields(self, spec: Any) -> CorrelatedRest:
        return self._with(self.pipe.add_fields(spec))

    def project(self, spec: Any) -> CorrelatedRest:
        own = dict(evaluate(self.pipe.df, spec))
        return self._with(self.pipe.project(own | dict.fromkeys(self.names, 1)))

    def group(self, spec: Any) -> CorrelatedRest:
        with building(self.pipe.df):
            own = dict(evaluate(self.pipe.df, spec))
            key = own.pop("_id")
            outputs = self.pipe._outputs(own, self.pipe.df)
            col = F.lit(None).cast("string") if key is None else to_col(key)
        return self._with(replace(self.pipe, df=self.pipe.df.groupBy(*self.names, col.alias("_id")).agg(*outputs.values()), order=()))

    def count(self, name: str) -> CorrelatedRest:
        return self._with(replace(self.pipe, df=self.pipe.df.groupBy(*self.names).agg(F.count(F.lit(1)).alias(name)), order=()))


__all__ = ["Acc", "Pipeline", "PipelineError", "type_of"]
