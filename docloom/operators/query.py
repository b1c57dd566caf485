"""Find-style reads, declared joins and scoping policies over a collection."""

from __future__ import annotations

import base64
import hmac
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fn
from ..functions.core import building, column, directions
from .filters import _document, _is_operators, compile_filter, near_order
from .pipeline import Pipeline, include_paths, list_id, rows_of
from .search import text_score


@dataclass(frozen=True)
class Policies:
    """Rewrites that scope every read: hidden fields, soft delete, tenant, discriminator, stored names."""

    hidden: tuple[str, ...] = ()
    deleted_at: str | None = None
    tenant: tuple[str, Any] | None = None
    discriminator: tuple[str, Any] | None = None
    names: dict[str, str] = field(default_factory=dict)

    def apply(self, df: DataFrame, include: tuple[str, ...] = (), with_deleted: bool = False) -> DataFrame:
        for stored, name in self.names.items():
            df = df.withColumnRenamed(stored, name)
        for rule in (self.tenant, self.discriminator):
            if rule:
                df = df.where(column(rule[0]).eqNullSafe(F.lit(rule[1])))
        if self.deleted_at and not with_deleted:
            df = df.where(column(self.deleted_at).isNull())
        return df.drop(*(h for h in self.hidden if h not in include))

    def delete(self, df: DataFrame, condition: Column) -> DataFrame:
        """A delete: with soft delete it marks the rows."""
        if not self.deleted_at:
            return df.where(~condition)
        mark = F.when(condition & column(self.deleted_at).isNull(), F.current_timestamp().cast(df.schema[self.deleted_at].dataType))
        return df.withColumn(self.deleted_at, F.coalesce(mark, column(self.deleted_at)))


@dataclass(frozen=True)
class Query:
    """A lazy find: where, select, sort, skip, limit; df() is the frame."""

    source: DataFrame
    filters: tuple = ()
    projection: Any = None
    keys: tuple = ()
    offset: int = 0
    most: int | None = None

    def where(self, spec: Any) -> Query:
        return replace(self, filters=(*self.filters, spec))

    def and_(self, *specs: dict) -> Query:
        return self.where({"$and": list(specs)})

    def or_(self, *specs: dict) -> Query:
        return self.where({"$or": list(specs)})

    def nor(self, *specs: dict) -> Query:
        return self.where({"$nor": list(specs)})

    def merge(self, other: Query) -> Query:
        return replace(self, filters=(*self.filters, *other.filters))

    def select(self, projection: Any) -> Query:
        return replace(self, projection=projection)

    def sort(self, spec: Any) -> Query:
        return replace(self, keys=tuple(directions(spec)))

    def skip(self, n: int) -> Query:
        return replace(self, offset=n)

    def limit(self, n: int) -> Query:
        if n < 1:
            raise ValueError("limit must be positive")
        return replace(self, most=n)

    def text_score(self, fields: list[str], query: str, name: str = "score") -> Query:
        return replace(self, source=self.source.withColumn(name, text_score([column(f) for f in fields], query)))

    def _matching(self) -> DataFrame:
        df = self.source
        for f in self.filters:
            df = df.where(compile_filter(df, f))
            if isinstance(f, dict):
                with building(df):
                    near = near_order(f)
                if near is not None:
                    df = df.orderBy(near)
        return df

    def df(self) -> DataFrame:
        df = self._matching()
        if self.keys:
            df = df.orderBy(*(column(p).asc() if up else column(p).desc() for p, up in self.keys))
        if self.offset:
            df = df.offset(self.offset)
        if self.most is not None:
            df = df.limit(self.most)
        return df if self.projection is None else project(df, self.projection)

    def count(self) -> int:
        df = self._matching()
        if self.offset:
            df = df.offset(self.offset)
        return (df if self.most is None else df.limit(self.most)).count()

    def exists(self) -> bool:
        return not self._matching().isEmpty()

    def exists_id(self, key: str = "_id") -> Any:
        """The key of a matching row, or None."""
        row = self._matching().select(F.col(f"`{key}`").alias("k")).limit(1).first()
        return None if row is None else row["k"]

    def parse(self, schema: T.StructType) -> DataFrame:
        """The rows, which must have these columns and types."""
        return Pipeline(self.df()).parse(schema)

    expect = parse

    def mask(self, rules: dict[str, Any]) -> DataFrame:
        return Pipeline(self.df()).mask(rules)

    def plain(self) -> DataFrame:
        return Pipeline(self.df()).plain()

    def distinct(self, path: str) -> DataFrame:
        """Distinct values, arrays unwound."""
        df = self._matching().select(column(path).alias("value"))
        while isinstance(df.schema["value"].dataType, T.ArrayType):
            df = df.select(F.explode("value").alias("value"))
        return df.where("value is not null").distinct()

    def or_fail(self) -> DataFrame:
        df = self.df()
        if df.isEmpty():
            raise LookupError("nothing found")
        return df

    def explain(self) -> None:
        self.df().explain("formatted")

    def each(self, run: Callable, schema: Any) -> DataFrame:
        return self.df().mapInPandas(run, schema)

    def keyset_page(self, limit: int, after: str | None = None, key: str = "_id", secret: bytes | None = None) -> tuple[DataFrame, Callable[[list], str | None]]:
        """Rows behind a token in the sort order, `limit` + 1 of them, and a function from the rows to the next token."""
        keys = [*self.keys, *([(key, True)] if key not in [p for p, _ in self.keys] else [])]
        df = self._matching()
        if after is not None:
            df = df.where(_behind(df, keys, read_token(after, secret)))
        df = df.orderBy(*(column(p).asc() if up else column(p).desc() for p, up in keys)).limit(limit + 1)

        def token(rows: list) -> str | None:
            return make_token([rows[limit - 1][p] for p, _ in keys], secret) if len(rows) > limit else None

        return df, token


def _behind(df: DataFrame, keys: list[tuple[str, bool]], values: list) -> Column:
    """Lexicographically after: nulls first when rising, last when falling."""
    out = F.lit(False)
    for (path, up), v in reversed(list(zip(keys, values, strict=True))):
        c, w = column(path), F.lit(v).cast(df.select(column(path).alias("x")).schema[0].dataType)
        later = fn.cmp(c, w) > 0 if up else fn.cmp(c, w) < 0
        out = later | (c.eqNullSafe(w) & out)
    return out


def make_token(values: list, secret: bytes | None = None) -> str:
    body = json.dumps([v.isoformat() if isinstance(v, datetime) else v for v in values]).encode()
    mark = hmac.new(secret, body, "sha256").digest() if secret else b""
    return base64.urlsafe_b64encode(mark + body).decode().rstrip("=")


def read_token(token: str, secret: bytes | None = None) -> list:
    raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
    mark, body = (raw[:32], raw[32:]) if secret else (b"", raw)
    if secret and not hmac.compare_digest(mark, hmac.new(secret, body, "sha256").digest()):
        raise ValueError("the token was changed")
    return json.loads(body)


def project(df: DataFrame, spec: Any) -> DataFrame:
    """{path: 1 | 0 | {$slice} | {$elemMatch} | {$meta}} or a list of names, a minus before the excluded."""
    if isinstance(spec, (list, tuple)):
        spec = {s.removeprefix("-").removeprefix("+"): 0 if s.startswith("-") else 1 for s in spec}
    special = {k: v for k, v in spec.items() if isinstance(v, dict)}
    flags = {k: v for k, v in spec.items() if k not in special}
    include = [k for k, v in flags.items() if v]
    exclude = [k for k, v in flags.items() if not v]
    if include and [k for k in exclude if k != "_id"]:
        raise ValueError("include and exclude don't mix")
    made = {}
    for path, how in special.items():
        if "$slice" in how:
            args = how["$slice"] if isinstance(how["$slice"], (list, tuple)) else [how["$slice"]]
            made[path] = fn.slice(column(path), *args)
        elif "$elemMatch" in how:
            kind = df.schema[path].dataType.elementType
            own = how["$elemMatch"]
            from .filters import _conditions

            test = (lambda x: _conditions(own, x, kind)) if _is_operators(own) else (lambda x: _document(own, x, kind))
            made[path] = F.slice(F.filter(column(path), lambda x: F.coalesce(test(x), F.lit(False))), 1, 1)
        elif "$meta" in how:
            made[path] = fn.meta(how["$meta"])
    if include or (special and not exclude and any("$elemMatch" in h or "$meta" in h for h in special.values()) and include):
        keep_id = ["_id"] if "_id" in df.columns and "_id" not in include and flags.get("_id", 1) else []
        return df.select(*include_paths(df, keep_id + [p for p in include if p not in made]), *(v.alias(k) for k, v in made.items()))
    out = Pipeline._dropped(df, exclude)
    return out.withColumns(made) if made else out


class Database:
    """Collections by name; a joined collection is scoped by its own policies at any depth."""

    def __init__(self, spark: SparkSession, collections: dict[str, Collection] | None = None):
        self.spark, self.collections = spark, dict(collections or {})

    def __getitem__(self, name: str) -> Collection:
        return self.collections[name]

    def aggregate(self, build: Callable[[Pipeline], Pipeline]) -> Pipeline:
        """A pipeline that starts from no collection: its first stage makes the rows."""
        return build(Pipeline.database(self.spark))


class Client(Database):
    """All databases of a session; aggregate() is for stages on the whole deployment."""

    def database(self, name: str) -> Database:
        rows = self.spark.catalog.listTables(name)
        return Database(self.spark, {t.name: Collection(self.spark.table(f"`{name}`.`{t.name}`")) for t in rows})


class Collection:
    """A named set of rows with its policies and declared references."""

    def __init__(self, df: DataFrame, key: str = "_id", policies: Policies = Policies()):
        self.raw, self.key, self.policies = df, key, policies

    def scoped(self, include: tuple[str, ...] = ()) -> DataFrame:
        return self.policies.apply(self.raw, include)

    def find(self, spec: Any = None, include: tuple[str, ...] = ()) -> Query:
        q = Query(self.scoped(include))
        return q if spec is None else q.where(spec)

    def find_one(self, spec: Any = None) -> DataFrame:
        return self.find(spec).limit(1).df()

    def find_by_id(self, value: Any) -> DataFrame:
        return self.find({self.key: value}).df()

    def estimated_count(self) -> int:
        return self.raw.count()

    def aggregate(self, build: Callable[[Pipeline], Pipeline], include: tuple[str, ...] = ()) -> Pipeline:
        return build(Pipeline(self.scoped(include)))


def populate(df: DataFrame, path: str, target: DataFrame, key: str = "_id", select: list[str] | None = None, match: Any = None, retain_null_values: bool = False, required: bool = False, transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """Puts the documents that `path` refers to in its place: one reference, an array of them, or a map of them.

    A missing single reference becomes null; missing array elements go unless retain_null_values; order stays.
    """
    target = rows_of(target)
    right = target if match is None else target.where(compile_filter(target, match))
    doc = F.struct(*(F.col(f"`{c}`") for c in (select or right.columns)))
    right = right.select(F.col(f"`{key}`").alias("__ref"), (transform(doc) if transform else doc).alias("__doc"))
    kind = df.schema[path].dataType
    if isinstance(kind, (T.ArrayType, T.MapType)):
        many = isinstance(kind, T.ArrayType)
        key_col = F.col(f"`{path}`") if many else F.array_sort(F.map_entries(F.col(f"`{path}`")))
        own = df.withColumn("__key", key_col).withColumn("__same", list_id("__key"))  # equal lists are looked up once
        lists = own.where("__key is not null").select("__same", "__key").dropDuplicates(["__same"])
        made = lists.select("__same", F.posexplode("__key").alias("__at", "__id"))
        ref = F.col("__id") if many else F.col("__id.value")
        found = made.join(right, ref == F.col("__ref"), "left" if retain_null_values else "inner")
        pair = F.struct("__at", F.col("__doc").alias("d"))
        rows = F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["d"]) if many else F.map_from_entries(F.collect_list(F.struct(F.col("__id.key").alias("key"), F.col("__doc").alias("value"))))
        found = found.groupBy("__same").agg(rows.alias("__docs"))
        kind = found.schema["__docs"].dataType
        empty = F.array().cast(kind) if many else F.create_map().cast(kind)
        out = own.join(found, "__same", "left")
        return out.withColumn(path, F.when(F.col("__key").isNotNull(), F.coalesce("__docs", empty))).select(*df.columns)
    out = df.join(right, F.col(f"`{path}`") == F.col("__ref"), "left")
    if required:
        out = out.withColumn("__doc", F.coalesce("__doc", F.when(F.lit(True), F.raise_error(F.lit(f"{path} refers to nothing")))))
    return out.withColumn(path, F.col("__doc")).drop("__ref", "__doc").select(*df.columns)


def populate_by(df: DataFrame, path: str, kind_path: str, targets: dict[str, DataFrame], key: str = "_id") -> DataFrame:
    """References whose target a column names: one join a target, the document as JSON."""
    out = df
    for i, (name, target) in enumerate(targets.items()):
        target = rows_of(target)
        right = target.select(F.col(f"`{key}`").cast("string").alias(f"__r{i}"), F.to_json(F.struct(*target.columns)).alias(f"__d{i}"))
        out = out.join(right, (F.col(kind_path) == name) & (F.col(f"`{path}`").cast("string") == F.col(f"__r{i}")), "left").drop(f"__r{i}")
    docs = F.coalesce(*(F.col(f"__d{i}") for i in range(len(targets))))
    return out.withColumn(path, docs).drop(*(f"__d{i}" for i in range(len(targets))))


def populate_virtual(df: DataFrame, as_: str, target: DataFrame, local: str, foreign: str, select: list[str] | None = None, match: Any = None, sort: Any = None, skip: int = 0, limit: int | None = None, per_document_limit: int | None = None, just_one: bool = False, count: bool = False) -> DataFrame:
    """Documents that refer back to each row; with a limit, the first of each row by the sort."""
    target = rows_of(target)
    right = target if match is None else target.where(compile_filter(target, match))
    if count:
        n = right.groupBy(F.col(f"`{foreign}`").alias("__f")).agg(F.count(F.lit(1)).alias(as_))
        return df.join(n, F.col(f"`{local}`") == F.col("__f"), "left").drop("__f").withColumn(as_, F.coalesce(as_, F.lit(0)))
    keys = directions(sort) if sort else []
    ties = [c for c in right.columns if c not in [p for p, _ in keys] and isinstance(right.schema[c].dataType, T.AtomicType)]
    most = 1 if just_one else per_document_limit if per_document_limit is not None else limit
    w = W.partitionBy(foreign).orderBy(*(column(p).asc() if up else column(p).desc() for p, up in keys), *(F.col(f"`{c}`") for c in ties))
    ranked = right.withColumn("__n", F.row_number().over(w))
    if skip or most is not None:
        ranked = ranked.where((F.col("__n") > skip) & (F.lit(True) if most is None else F.col("__n") <= skip + most))
    doc = F.struct(*(F.col(f"`{c}`") for c in (select or right.columns)))
    rows = ranked.groupBy(F.col(f"`{foreign}`").alias("__f")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", doc.alias("d")))), lambda x: x["d"]).alias(as_))
    out = df.join(rows, F.col(f"`{local}`") == F.col("__f"), "left").drop("__f")
    if just_one:
        return out.withColumn(as_, F.get(as_, F.lit(0)))
    return out.withColumn(as_, F.coalesce(as_, F.array().cast(rows.schema[as_].dataType)))
