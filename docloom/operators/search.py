"""Text search, vector search and rank fusion."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fn
from ..functions.core import column

RRF_K = 60


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def parse_query(query: str) -> tuple[list[str], list[str], list[str]]:
    """Words, phrases in quotes, and words with a minus."""
    phrases = re.findall(r'"([^"]+)"', query)
    rest = re.sub(r'"[^"]*"', " ", query).lower().split()
    return [w for w in rest if not w.startswith("-")], [p.lower() for p in phrases], [w[1:] for w in rest if len(w) > 1 and w.startswith("-")]


def text_score(fields: list[Column], query: str) -> Column:
    """Occurrences of the query's words over all fields."""
    words, phrases, _ = parse_query(query)
    wanted = words + [w for p in phrases for w in p.split()]
    own = F.concat(*(tokens(f) for f in fields))
    return F.size(F.filter(own, lambda x: x.isin(*wanted))).cast("double") if wanted else F.lit(0.0)


def text_match(fields: list[Column], query: str) -> Column:
    words, phrases, without = parse_query(query)
    own, whole = F.concat(*(tokens(f) for f in fields)), F.lower(F.concat_ws("\n", *fields))
    out = F.arrays_overlap(own, F.array(*map(F.lit, words))) if words and not phrases else F.lit(bool(phrases))
    for p in phrases:
        out = out & whole.contains(p)
    for w in without:
        out = out & ~F.array_contains(own, w)
    return F.coalesce(out, F.lit(False))


def search(df: DataFrame, spec: dict) -> DataFrame:
    """text, phrase, wildcard, equals, range, exists and compound; the score goes to __meta_searchScore."""
    match, score = _clause(df, spec)
    return df.where(match).withColumn("__meta_searchScore", score)


def _paths(path: Any, df: DataFrame) -> list[Column]:
    if isinstance(path, dict):
        return [column(f.name) for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return [column(p) for p in (path if isinstance(path, (list, tuple)) else [path])]


def _clause(df: DataFrame, spec: dict) -> tuple[Column, Column]:
    kind = next(k for k in spec if k not in ("index", "highlight", "count", "sort"))
    own = spec[kind]
    if kind == "text":
        query = own["query"] if isinstance(own["query"], str) else " ".join(own["query"])
        fields = _paths(own["path"], df)
        return text_match(fields, query), text_score(fields, query)
    if kind == "phrase":
        query = '"' + own["query"] + '"'
        fields = _paths(own["path"], df)
        return text_match(fields, query), text_score(fields, query)
    if kind in ("wildcard", "regex"):
        pattern = own["query"] if kind == "regex" else "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in own["query"])
        found = F.lit(False)
        for f in _paths(own["path"], df):
            found = found | F.coalesce(f.rlike(f"(?s)^(?:{pattern})$"), F.lit(False))
        return found, F.lit(1.0)
    if kind == "equals":
        return column(own["path"]).eqNullSafe(fn.c(own["value"])), F.lit(1.0)
    if kind == "in":
        return F.coalesce(column(own["path"]).isin(*own["value"]), F.lit(False)), F.lit(1.0)
    if kind == "range":
        out, col = F.lit(True), column(own["path"])
        for name, test in (("gt", col.__gt__), ("gte", col.__ge__), ("lt", col.__lt__), ("lte", col.__le__)):
            if name in own:
                out = out & F.coalesce(test(fn.c(own[name])), F.lit(False))
        return out, F.lit(1.0)
    if kind == "exists":
        return column(own["path"]).isNotNull(), F.lit(1.0)
    if kind == "compound":
        match, score = F.lit(True), F.lit(0.0)
        for part in own.get("must", []):
            m, s = _clause(df, part)
            match, score = match & m, score + s
        for part in own.get("filter", []):
            match = match & _clause(df, part)[0]
        for part in own.get("mustNot", []):
            match = match & ~_clause(df, part)[0]
        should = [_clause(df, part) for part in own.get("should", [])]
        if should:
            hits = sum((F.when(m, 1).otherwise(0) for m, _ in should), F.lit(0))
            least = own.get("minimumShouldMatch", 0 if own.get("must") or own.get("filter") else 1)
            match = match & (hits >= least)
            score = sum((F.when(m, s).otherwise(0.0) for m, s in should), score)
        return match, score
    raise ValueError(f"unknown search operator {kind!r}")


def search_meta(df: DataFrame, spec: dict) -> DataFrame:
    """Counts of a search, or its facets: {facet: {operator, facets: {name: {type, path, boundaries?}}}}."""
    if "facet" not in spec:
        n = search(df, spec).agg(F.count(F.lit(1)).alias("n"))
        return n.select(F.struct(F.col("n").alias("total")).alias("count"))
    own = spec["facet"]
    found = search(df, own["operator"]) if "operator" in own else df
    out = found.agg(F.struct(F.count(F.lit(1)).alias("total")).alias("count"))
    for name, facet in own["facets"].items():
        col = column(facet["path"])
        if facet["type"] == "string":
            key = col
        else:
            key = F.lit(None)
            for low, high in zip(facet["boundaries"], facet["boundaries"][1:], strict=False):
                key = F.when((col >= fn.c(low)) & (col < fn.c(high)), fn.c(low)).otherwise(key)
        buckets = found.select(key.alias("_id")).where("_id is not null").groupBy("_id").agg(F.count(F.lit(1)).alias("count"))
        if facet["type"] == "string":
            buckets = buckets.orderBy(F.desc("count"), "_id").limit(facet.get("numBuckets", 10))
        rows = buckets.agg(F.array_sort(F.collect_list(F.struct("_id", "count"))).alias(name))
        out = out.crossJoin(F.broadcast(rows))  # one row each
    return out


SIMILARITIES = {"cosine": fn.similarity_cosine, "dotProduct": fn.similarity_dot_product, "euclidean": fn.similarity_euclidean}


def vector_search(df: DataFrame, path: str, query_vector: list[float], limit: int, similarity: str = "cosine", filter: Any = None, id_col: str | None = None) -> DataFrame:
    """The `limit` nearest rows, exact; the score goes to __meta_vectorSearchScore. Ties go to the smaller id."""
    from .filters import compile_filter

    if filter is not None:
        df = df.where(compile_filter(df, filter))
    query = F.array(*(F.lit(float(x)) for x in query_vector))
    scored = df.where(column(path).isNotNull()).withColumn("__meta_vectorSearchScore", SIMILARITIES[similarity](column(path), query, score=True))
    ties = [F.col(id_col)] if id_col else []
    return scored.orderBy(F.desc("__meta_vectorSearchScore"), *ties).limit(limit)


def rank_fusion(branches: dict[str, DataFrame], key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """branches: rows with __rank from 1. The rows with __meta_score = sum of weight / (k + rank), best first."""
    parts = None
    for name, df in branches.items():
        own = df.withColumn("__part", F.lit(float((weights or {}).get(name, 1.0))) / (RRF_K + F.col("__rank"))).drop("__rank")
        parts = own if parts is None else parts.unionByName(own, allowMissingColumns=True)
    rest = [c for c in parts.columns if c not in (key, "__part")]
    out = parts.groupBy(key).agg(*(F.first(c, ignorenulls=True).alias(c) for c in rest), F.sum("__part").alias("__meta_score"))
    return out.orderBy(F.desc("__meta_score"), key)


def scaled(df: DataFrame, score: Column, how: str | None, name: str) -> DataFrame:
    """df with the normalised score; the least and largest come from one aggregated row, not from a window over all rows."""
    if how in (None, "none"):
        return df.withColumn(name, score.cast("double"))
    if how == "sigmoid":
        return df.withColumn(name, fn.sigmoid(score))
    if how != "minMaxScaler":
        raise ValueError(f"unknown normalization {how!r}")
    own = df.withColumn(name, score.cast("double"))
    ends = own.agg(F.min(name).alias("__low"), F.max(name).alias("__high"))
    share = (F.col(name) - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0))
    return own.crossJoin(F.broadcast(ends)).withColumn(name, F.coalesce(share, F.lit(0.0))).drop("__low", "__high")  # one row
