"""Queries over single functions, stages and commands, each with its oracle SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fn
from ..operators.filters import Filters, Where
from ..operators.pipeline import Pipeline
from ..operators.query import Collection, Database, Policies, Query, populate, populate_by, populate_virtual
from ..operators.update import Writer
from ..sources.collections import Materialized, View
from ..sources.scratch import scratch_path
from ..streaming.change_log import apply_changes, log_schema, shape_events
from .queries import _ITEMS, _NULLS, _items, _r, _t, query


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _one(s: SparkSession, value: object, schema: str) -> DataFrame:
    return s.createDataFrame([(value,)], schema)


# --- functions


@query("select p_partkey, substr(p_name, 1, 3) a, substr(p_name, 3, 4) b, rtrim(p_type || 'xx  ', 'x ') c from part")
def str_bytes(s, d):
    return _t(s, d, "part").project(lambda f: {"p_partkey": 1, "a": fn.substr_bytes(f.p_name, 0, 3), "b": fn.substr(f.p_name, 2, 4), "c": fn.rtrim(fn.concat(f.p_type, "xx  "), "x ")}).df


@query(f"select event_id, v is distinct from 50 a, coalesce(v >= 50, false) b, coalesce(v <= 50, true) c, coalesce(v > 50, false) d, coalesce(v < 50, true) e from {_NULLS}")
def compare_all(s, d):
    p = _t(s, d, "events").project(lambda f: {"event_id": 1, "v": F.when(f.event_id % 7 != 0, f.value)})
    return p.project(lambda f: {"event_id": 1, "a": fn.ne(f.v, 50.0), "b": fn.gte(f.v, 50.0), "c": fn.lte(f.v, 50.0), "d": fn.gt(f.v, 50.0), "e": fn.lt(f.v, 50.0)}).df


@query(f"select _id, len(list_filter(items, lambda x: x.qty > 45)) > 0 a from {_ITEMS}")
def any_element_true(s, d):
    return _items(s, d).project(lambda f: {"_id": 1, "a": fn.any_element_true(fn.map(f.items, lambda x: x["qty"] > 45))}).df


@query("select p_partkey, p_size a, 2::bigint n, 'a' rest, p_size * 2 + 1 l from part")
def objects_more(s, d):
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    p = _t(s, d, "part").add_fields(lambda f: {"m": fn.array_to_object(F.array(pair("a", f.p_size), pair("b", f.p_size + 1))), "o": F.struct(f.p_size.alias("a"), f.p_name.alias("b"))})
    p = p.add_fields(lambda f: {"kept": fn.unset_field("b", f.o)})
    return p.project(lambda f: {"p_partkey": 1, "a": f.m["a"], "n": F.size(f.m).cast("bigint"), "rest": F.array_join(F.transform(fn.object_to_array(f.kept), lambda x: x["k"]), ","), "l": fn.let({"x": f.p_size, "y": 2}, lambda x, y: fn.add(fn.multiply(x, y), 1))}).df


@query("select event_id, (extract(millisecond from ts)::bigint % 1000)::int ms, year(ts)::int y, month(ts)::int m, day(ts)::int dd, hour(ts)::int h, minute(ts)::int mi, second(ts)::int sec, isoyear(ts)::int iy, weekofyear(ts)::int iw, isodow(ts)::int id from events")
def date_parts(s, d):
    p = _t(s, d, "events").add_fields(lambda f: {"a": fn.date_to_parts(f.ts), "b": fn.date_to_parts(f.ts, iso8601=True)})
    names = {"y": "a.year", "m": "a.month", "dd": "a.day", "h": "a.hour", "mi": "a.minute", "sec": "a.second", "iy": "b.isoWeekYear", "iw": "b.isoWeek", "id": "b.isoDayOfWeek"}
    return p.project(lambda f: {"event_id": 1, "ms": fn.millisecond(f.ts)} | {k: f[v].cast("int") for k, v in names.items()}).df


@query("select p_partkey, p_partkey a, p_size b from part")
def timestamps(s, d):
    p = _t(s, d, "part").add_fields(lambda f: {"stamp": F.struct(f.p_partkey.alias("t"), f.p_size.alias("i"))})
    return p.project(lambda f: {"p_partkey": 1, "a": fn.ts_second(f.stamp), "b": fn.ts_increment(f.stamp)}).df


@query("select p_partkey, trunc(p_retailprice)::bigint a, p_size::double b, round(p_retailprice, 2) c, make_timestamp(p_partkey * 86400000000) e, make_timestamp((1600000000 + p_partkey) * 1000000) g, trunc(p_retailprice)::int i from part")
def convert_more(s, d):
    oid = lambda f: F.format_string("%08x%016x", f.p_partkey + 1_600_000_000, f.p_partkey)
    return _t(s, d, "part").project(lambda f: {"p_partkey": 1, "a": fn.to_long(f.p_retailprice), "b": fn.to_double(f.p_size), "c": _r(fn.to_decimal(f.p_retailprice), 2), "e": fn.to_date(f.p_partkey * 86_400_000), "g": fn.to_date(oid(f)), "i": fn.to_int(f.p_retailprice)}).df


@query("select p_partkey, printf('%024x', p_partkey) a, printf('aabbccdd-0000-4000-8000-%012x', p_partkey) b from part")
def identifiers(s, d):
    return _t(s, d, "part").project(lambda f: {"p_partkey": 1, "a": fn.to_object_id(F.upper(F.format_string("%024x", f.p_partkey))), "b": fn.to_uuid(F.upper(F.format_string("aabbccdd-0000-4000-8000-%012x", f.p_partkey)))}).df


@query("select p_partkey, p_size a, true b, false c, 0 e from part")
def arrays_more(s, d):
    p = _t(s, d, "part").add_fields(lambda f: {"x": fn.to_array(fn.concat("[", fn.to_string(f.p_size), ",2]"), "int")})
    return p.project(lambda f: {"p_partkey": 1, "a": f.x[0], "b": fn.is_array(f.x), "c": fn.is_array(f.p_size), "e": fn.subtype(F.encode(f.p_name, "UTF-8"))}).df


@query("select p_partkey, upper(md5(p_name)) a, upper(sha256(p_name)) b, 20 + octet_length(encode(p_name)) c from part")
def hashes_more(s, d):
    return _t(s, d, "part").project(lambda f: {"p_partkey": 1, "a": F.hex(fn.hash(f.p_name, "md5")), "b": F.hex(fn.hash(f.p_name, "sha256")), "c": fn.bson_size(F.struct(f.p_size.alias("a"), f.p_name.alias("b"))).cast("bigint")}).df


@query("select count(*) n, count(*) ids, count(distinct p_brand) keys, count(*) inside from part")
def random_values(s, d):
    p = _t(s, d, "part").add_fields(lambda f: {"id": fn.create_object_id(), "key": fn.to_hashed_index_key(f.p_brand), "x": fn.rand()})
    return p.df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").rlike("^[0-9a-f]{24}$")).alias("ids"), F.countDistinct("key").alias("keys"), F.count_if((F.col("x") >= 0) & (F.col("x") < 1)).alias("inside"))


@query("""select p_partkey, '{"a":' || p_size || ',"b":"' || p_brand || '"}' a, '{"a":{"$numberInt":"' || p_size || '"},"b":"' || p_brand || '"}' b from part""")
def ejson_out(s, d):
    doc = lambda f: F.struct(f.p_size.alias("a"), f.p_brand.alias("b"))
    return _t(s, d, "part").project(lambda f: {"p_partkey": 1, "a": fn.serialize_ejson(doc(f)), "b": fn.serialize_ejson(doc(f), relaxed=False)}).df


@query("select event_id, (props::json ->> '$.k')::int k, -1 other from events")
def ejson_in(s, d):
    p = _t(s, d, "events").add_fields(lambda f: {"v": fn.deserialize_ejson(f.props), "w": fn.deserialize_ejson(fn.literal("{broken"), '{"k": -1}')})
    return p.project(lambda f: {"event_id": 1, "k": F.variant_get(f.v, "$.k", "int"), "other": F.variant_get(f.w, "$.k", "int")}).df


@query("select count(*) n, 1::bigint now, 1::bigint later, 1::bigint roles from part")
def variables(s, d):
    p = _t(s, d, "part").add_fields(lambda f: {"now": fn.now(), "stamp": fn.cluster_time(), "roles": fn.user_roles()})
    return p.df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("now").alias("now"), F.countDistinct(F.col("stamp.i")).alias("later"), F.max(F.size("roles")).cast("bigint").alias("roles"))


# --- stages


@query("select least(50, count(*)) n, least(50, count(*)) different from part")
def sample(s, d):
    return _t(s, d, "part").sample(50).df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_partkey").alias("different"))


@query("select c_custkey k, c_name n from customer")
def replace_with(s, d):
    return _t(s, d, "customer").replace_with(lambda f: {"k": f.c_custkey, "n": f.c_name}).df


@query("select * from (values (1::bigint, 'a'), (2::bigint, null)) t(k, n)")
def documents_stage(s, d):
    return Database(s).aggregate(lambda p: p.documents([{"k": 1, "n": "a"}, {"k": 2, "n": None}], "k long, n string")).df


@query("select o_orderstatus _id, count(*) n from orders group by 1")
def out_stage(s, d):
    return _t(s, d, "orders").group(lambda f: {"_id": f.o_orderstatus, "n": fn.count()}).out(scratch_path(s, "out"))


@query("select o_orderstatus _id, count(*) * 2 n from orders group by 1")
def merge_stage(s, d):
    path = scratch_path(s, "merge")
    p = _t(s, d, "orders").group(lambda f: {"_id": f.o_orderstatus, "n": fn.count()})
    p.out(path)
    return p.merge(path, when_matched=lambda o, n: {"n": fn.add(o.n, n.n)})


@query("select count(*) total from part where p_size between 10 and 20")
def search_meta(s, d):
    p = _t(s, d, "part").search_meta({"range": {"path": "p_size", "gte": 10, "lte": 20}})
    return p.project(lambda f: {"total": f["count.total"]}).df


@query("select count(*) total, (select string_agg(p_brand || ':' || n, ',' order by p_brand, n) from (select p_brand, count(*) n from part where p_size >= 10 group by 1 order by n desc, p_brand limit 3)) brands from part where p_size >= 10")
def search_facets(s, d):
    spec = {"facet": {"operator": {"range": {"path": "p_size", "gte": 10}}, "facets": {"brands": {"type": "string", "path": "p_brand", "numBuckets": 3}}}}
    p = _t(s, d, "part").search_meta(spec)
    return p.project(lambda f: {"total": f["count.total"], "brands": F.array_join(F.transform(f.brands, lambda x: F.concat_ws(":", x["_id"], x["count"])), ",")}).df


@query("select p_partkey from part where (p_type like 'E%' or p_size = 7) and p_brand <> 'Brand#11' and p_size in (5, 6, 7, 8, 9)")
def search_compound(s, d):
    spec = {"compound": {"should": [{"wildcard": {"path": "p_type", "query": "E*"}}, {"equals": {"path": "p_size", "value": 7}}], "mustNot": [{"equals": {"path": "p_brand", "value": "Brand#11"}}], "filter": [{"in": {"path": "p_size", "value": [5, 6, 7, 8, 9]}}], "minimumShouldMatch": 1}}
    return _t(s, d, "part").search(spec).project({"p_partkey": 1}).df


@query("select count(*) count, 1 files from part")
def coll_stats(s, d):
    return _t(s, d, "part").coll_stats().df


@query("select 0::bigint n")
def system_stages(s, d):
    """Statistics that Spark has no counterpart for: their rows' schema, and no rows."""
    p = _t(s, d, "region")
    frames = [p.index_stats(), p.plan_cache_stats(), p.list_search_indexes(), p.query_stats(), p.list_sampled_queries(), p.query_settings()]
    out = frames[0].df.select(F.lit(1).alias("x"))
    for f in frames[1:]:
        out = out.unionByName(f.df.select(F.lit(1).alias("x")))
    return out.agg(F.count("x").alias("n"))


@query("select 1::bigint sessions, 1::bigint here, count(*) owned from region")
def deployment_stages(s, d):
    p = _t(s, d, "region")
    sessions = p.list_sessions().df.agg(F.count(F.lit(1)).alias("sessions"))
    here = p.list_local_sessions().df.agg(F.count(F.lit(1)).alias("here"))
    owned = p.sharded_data_distribution().df.agg(F.sum("numOwnedDocuments").alias("owned"))
    return sessions.crossJoin(here).crossJoin(owned)  # one row each


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def semi_join(s, d):
    return _t(s, d, "customer").lookup_exists(_t(s, d, "orders").match({"o_orderstatus": "F"}), "c_custkey", "o_custkey").project({"c_custkey": 1}).df


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_join(s, d):
    return _t(s, d, "customer").lookup_exists(_table(s, d, "orders"), "c_custkey", "o_custkey", missing=True).project({"c_custkey": 1}).df


@query("select c_custkey, o_orderkey from customer join orders on o_custkey = c_custkey")
def lookup_unwind_inner(s, d):
    p = _t(s, d, "customer").lookup_unwind(_table(s, d, "orders"), "c_custkey", "o_custkey", "o")
    return p.project(lambda f: {"c_custkey": 1, "o_orderkey": f["o.o_orderkey"]}).df


@query("select o.o_orderkey, (select max(p.o_orderdate) from orders p where p.o_custkey = o.o_custkey and p.o_orderdate < o.o_orderdate) before from orders o")
def asof_join(s, d):
    sub = lambda p, outer: p.match(lambda f: (f.k == outer.c) & (f.at < outer.t)).sort({"at": -1}).limit(1)
    prior = _table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"))
    p = _t(s, d, "orders").lookup("p", prior, let=lambda f: {"c": f.o_custkey, "t": f.o_orderdate}, pipeline=sub)
    return p.project(lambda f: {"o_orderkey": 1, "before": F.get(f["p.at"], F.lit(0))}).df


@query("select s_suppkey, count(l_orderkey) n from supplier left join (select l_orderkey, l_suppkey from lineitem where l_quantity > 49) on l_suppkey between s_suppkey and s_suppkey + 1 group by 1")
def range_join(s, d):
    sub = lambda p, outer: p.match(lambda f: (f.l_suppkey >= outer.k) & (f.l_suppkey <= outer.k + 1)).project({"l_orderkey": 1})
    lines = _table(s, d, "lineitem").where("l_quantity > 49").select("l_orderkey", "l_suppkey")
    p = _t(s, d, "supplier").lookup("x", lines, let=lambda f: {"k": f.s_suppkey}, pipeline=sub)
    return p.project(lambda f: {"s_suppkey": 1, "n": fn.size(f.x).cast("bigint")}).df


@query("select c_custkey, string_agg(n_name, ',' order by n_nationkey) names from customer join nation on n_nationkey in (c_nationkey, 3) group by 1")
def lookup_list(s, d):
    p = _t(s, d, "customer").add_fields(lambda f: {"keys": F.array(f.c_nationkey, F.lit(3))}).lookup("n", _table(s, d, "nation"), "keys", "n_nationkey")
    return p.project(lambda f: {"c_custkey": 1, "names": F.array_join(f["n.n_name"], ",")}).df


@query("""with recursive r as (select 9.0 lo union all select 9.0), c as (select p_size k, count(*) n from part where p_size > 0 group by 1), b as (select *, coalesce(sum(n) over (order by k rows between unbounded preceding and 1 preceding), 0) p, sum(n) over () t from c),
 g as (select *, least(floor(p / greatest(round(t / 4), 1)), 3) g from b), o as (select g, min(k) lo, max(k) hi, sum(n) n from g group by 1), v as (select unnest([1.0, 1.6, 2.5, 4.0, 6.3, 10.0, 16.0, 25.0, 40.0, 63.0, 100.0, 0.63, 0.4]) x)
 select (case when g = 0 then (select max(x) from v where x < lo) else (select min(x) from v where x > lo) end)::double lo, (coalesce((select min(x) from v where x > (select lo from o p where p.g = o.g + 1)), (select min(x) from v where x > hi)))::double hi, n::bigint n from o""")
def bucket_auto_granular(s, d):
    p = _t(s, d, "part").match({"p_size": {"$gt": 0}}).bucket_auto(lambda f: f.p_size, 4, granularity="R5")
    return p.project(lambda f: {"_id": 0, "lo": f["_id.min"], "hi": f["_id.max"], "n": f["count"]}).df


# --- filters


def _places(s: SparkSession, d: str) -> Pipeline:
    return _t(s, d, "customer").add_fields(lambda f: {"at": F.array((f.c_custkey % 100).cast("double") + 0.5, (f.c_custkey % 77).cast("double") + 0.25)})


_PLACES = "(select c_custkey, (c_custkey % 100) + 0.5 x, (c_custkey % 77) + 0.25 y from customer)"


@query(f"select c_custkey from {_PLACES} where x between 10 and 40 and y between 10 and 50 and not (x between 20 and 30 and y between 20 and 30)")
def geo_polygon(s, d):
    rings = [[[10, 10], [40, 10], [40, 50], [10, 50], [10, 10]], [[20, 20], [30, 20], [30, 30], [20, 30], [20, 20]]]
    return _places(s, d).match({"at": {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": rings}}}}).project({"c_custkey": 1}).df


@query(f"select c_custkey from {_PLACES} where (y < x and x < 60) and y > 0")
def geo_plain_polygon(s, d):
    return _places(s, d).match({"at": {"$geoWithin": {"$polygon": [[0, 0], [60, 0], [60, 60]]}}}).project({"c_custkey": 1}).df


@query(f"select c_custkey from {_PLACES} where pow(x - 50, 2) + pow(y - 30, 2) <= 400")
def geo_center(s, d):
    return _places(s, d).match({"at": {"$geoWithin": {"$center": [[50, 30], 20]}}}).project({"c_custkey": 1}).df


_ARC = "2 * asin(sqrt(least(pow(sin(radians(y - 30) / 2), 2) + cos(radians(30)) * cos(radians(y)) * pow(sin(radians(x - 50) / 2), 2), 1)))"


@query(f"select c_custkey from {_PLACES} where {_ARC} <= 0.3")
def geo_center_sphere(s, d):
    return _places(s, d).match({"at": {"$geoWithin": {"$centerSphere": [[50, 30], 0.3]}}}).project({"c_custkey": 1}).df


@query(f"select c_custkey from {_PLACES} where (x between 10 and 20 and y between 10 and 20) or (x between 50 and 60 and y between 30 and 40)")
def geo_intersects(s, d):
    square = lambda a, b: [[[a, b], [a + 10, b], [a + 10, b + 10], [a, b + 10], [a, b]]]
    return _places(s, d).match({"at": {"$geoIntersects": {"$geometry": {"type": "MultiPolygon", "coordinates": [square(10, 10), square(50, 30)]}}}}).project({"c_custkey": 1}).df


@query(f"select c_custkey from {_PLACES} where {_ARC} * 6378100 between 500000 and 2000000")
def geo_near_filter(s, d):
    near = {"$geometry": {"type": "Point", "coordinates": [50, 30]}, "$minDistance": 500_000, "$maxDistance": 2_000_000}
    return _places(s, d).match({"at": {"$nearSphere": near}}).project({"c_custkey": 1}).df


@query(f"select c_custkey from {_PLACES} where sqrt(pow(x - 50, 2) + pow(y - 30, 2)) <= 15")
def geo_near_plain(s, d):
    return _places(s, d).match({"at": {"$near": [50, 30], "$maxDistance": 15}}).project({"c_custkey": 1}).df


@query("select p_partkey from part where (p_size & 3) <> 3 and p_size % 2 = 1 and true")
def filter_bits_any_clear(s, d):
    return _t(s, d, "part").match({"p_size": {"$bitsAnyClear": 3, "$bitsAllSet": 1}, "$comment": "odd sizes", "$sampleRate": 1.0}).project({"p_partkey": 1}).df


@query("select doc_id from documents where list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['the', 'la'])")
def filter_text(s, d):
    return _t(s, d, "documents").project({"doc_id": 1, "text": 1}).match({"$text": {"$search": "the la"}}).project({"doc_id": 1}).df


@query("select o_orderkey from orders where o_orderstatus in ('O', 'F') and o_totalprice > 1000 and not (o_orderkey % 2 = 0 or o_custkey < 10) and (o_orderpriority like '1%' or o_orderpriority like '2%')")
def find_logic(s, d):
    q = Query(_table(s, d, "orders")).where(Filters.all()).and_({"o_orderstatus": {"$in": ["O", "F"]}}, Where("o_totalprice").gt(1000).spec()).nor({"o_orderkey": {"$mod": [2, 0]}}, {"o_custkey": {"$lt": 10}})
    q = q.merge(Query(_table(s, d, "orders")).or_({"o_orderpriority": {"$regex": "^1"}}, {"o_orderpriority": {"$regex": "^2"}}))
    return q.df().select("o_orderkey")


# --- reads


@query("select c_custkey, c_name from customer where c_custkey = 5")
def find_by_id(s, d):
    return Collection(_table(s, d, "customer"), "c_custkey").find_by_id(5).select("c_custkey", "c_name")


@query("select count(*) n from (select 1 from customer where c_custkey = 5 limit 1)")
def find_one(s, d):
    return Collection(_table(s, d, "customer"), "c_custkey").find_one({"c_custkey": 5}).agg(F.count(F.lit(1)).alias("n"))


@query("select true found, 5::bigint id, false other")
def find_exists(s, d):
    c = Collection(_table(s, d, "customer"), "c_custkey")
    return s.createDataFrame([(c.find({"c_custkey": 5}).exists(), c.find({"c_custkey": 5}).exists_id("c_custkey"), c.find({"c_custkey": -1}).exists())], "found boolean, id long, other boolean")


@query("select count(*) a, count(*) filter (c_acctbal > 0) b, least(10, greatest(count(*) filter (c_acctbal > 0) - 5, 0)) c from customer")
def count_documents(s, d):
    c = Collection(_table(s, d, "customer"), "c_custkey")
    return s.createDataFrame([(c.estimated_count(), c.find({"c_acctbal": {"$gt": 0}}).count(), c.find({"c_acctbal": {"$gt": 0}}).skip(5).limit(10).count())], "a long, b long, c long")


@query(f"select _id, len(items[1:2])::bigint a, coalesce(list_filter(items, lambda x: x.qty > 30)[1].line, -1) b from {_ITEMS}")
def select_array_parts(s, d):
    a = Query(_items(s, d).df).select({"_id": 1, "items": {"$slice": 2}}).df().select(F.col("_id").alias("k"), F.size("items").cast("bigint").alias("a"))
    b = Query(_items(s, d).df).select({"_id": 1, "items": {"$elemMatch": {"qty": {"$gt": 30}}}}).df()
    return b.join(a, F.col("k") == F.col("_id")).select("_id", "a", F.coalesce(F.get("items.line", F.lit(0)), F.lit(-1)).alias("b"))


@query("select doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x in ('the', 'le')))::double score from documents")
def find_text_score(s, d):
    return Query(_table(s, d, "documents")).text_score(["text"], "the le").select({"doc_id": 1, "score": 1}).df()


@query("select o_orderkey::varchar o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') o_orderdate from orders")
def find_plain(s, d):
    return Query(_table(s, d, "orders")).select({"o_orderkey": 1, "o_orderstatus": 1, "o_orderdate": 1}).plain().select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("select c_custkey, sha256(c_name) c_name, '***' c_mktsegment from customer")
def find_masked(s, d):
    return Query(_table(s, d, "customer")).select({"c_custkey": 1, "c_name": 1, "c_mktsegment": 1}).mask({"c_name": "hash", "c_mktsegment": "redact"})


@query("select c_custkey, c_name from customer")
def find_parsed(s, d):
    df = _table(s, d, "customer").select("c_custkey", "c_name")
    return Query(df).parse(df.schema)


@query("select p_partkey, p_size from part where p_size < 5")
def or_fail(s, d):
    return Query(_table(s, d, "part")).where({"p_size": {"$lt": 5}}).or_fail().select("p_partkey", "p_size")


@query("select c_custkey, c_name, count(o_orderkey) n from customer left join (select * from orders where o_orderstatus = 'O' and o_orderkey % 3 <> 0) on o_custkey = c_custkey where c_nationkey < 20 group by all")
def policies_on_joins(s, d):
    orders = _table(s, d, "orders").withColumn("gone", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")))
    db = Database(s, {"customer": Collection(_table(s, d, "customer").where("c_nationkey < 20"), "c_custkey", Policies(hidden=("c_acctbal",))), "orders": Collection(orders, "o_orderkey", Policies(deleted_at="gone", tenant=("o_orderstatus", "O")))})
    p = db["customer"].aggregate(lambda p: p.lookup("o", db["orders"], "c_custkey", "o_custkey"))
    return p.project(lambda f: {"c_custkey": 1, "c_name": 1, "n": fn.size(f.o).cast("bigint")}).df


@query("select p_partkey, p_brand from part where p_type like 'E%' and p_size > 3")
def discriminator_and_names(s, d):
    c = Collection(_table(s, d, "part").withColumn("kind", F.substring("p_type", 1, 1)), "p_partkey", Policies(discriminator=("kind", "E"), names={"p_size": "size"}))
    return c.find({"size": {"$gt": 3}}).df().select("p_partkey", "p_brand")


@query("select c_custkey, n_name a, n_name b from customer left join nation on n_nationkey = c_nationkey")
def populate_map(s, d):
    own = _table(s, d, "customer").select("c_custkey", F.create_map(F.lit("home"), F.col("c_nationkey")).alias("refs"), F.col("c_nationkey").alias("one"))
    nation = _table(s, d, "nation")
    out = populate(populate(own, "refs", nation, "n_nationkey", ["n_name"]), "one", nation, "n_nationkey", ["n_name"], required=True)
    return out.select("c_custkey", F.col("refs")["home"]["n_name"].alias("a"), F.col("one.n_name").alias("b"))


@query("select c_custkey, 2::bigint n, 1::bigint kept from customer")
def populate_retain(s, d):
    own = _table(s, d, "customer").select("c_custkey", F.array(F.col("c_nationkey"), F.lit(-1)).alias("refs"))
    nation = _table(s, d, "nation")
    n = populate(own, "refs", nation, "n_nationkey", retain_null_values=True).select("c_custkey", F.size("refs").cast("bigint").alias("n"))
    kept = populate(own, "refs", nation, "n_nationkey").select("c_custkey", F.size("refs").cast("bigint").alias("kept"))
    return n.join(kept, "c_custkey")


@query("select c_custkey, case when c_custkey % 2 = 0 then n_name else r_name end name from customer left join nation on n_nationkey = c_custkey % 5 left join region on r_regionkey = c_custkey % 5")
def populate_ref_path(s, d):
    own = _table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("ref"), F.when(F.col("c_custkey") % 2 == 0, "nation").otherwise("region").alias("kind"))
    nation, region = _table(s, d, "nation").select(F.col("n_nationkey").alias("_id"), F.col("n_name").alias("name")), _table(s, d, "region").select(F.col("r_regionkey").alias("_id"), F.col("r_name").alias("name"))
    out = populate_by(own, "ref", "kind", {"nation": nation, "region": region})
    return out.select("c_custkey", F.get_json_object("ref", "$.name").alias("name"))


@query("select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) best from customer")
def populate_just_one(s, d):
    out = populate_virtual(_table(s, d, "customer"), "o", _table(s, d, "orders"), "c_custkey", "o_custkey", sort={"o_totalprice": -1}, just_one=True)
    return out.select("c_custkey", F.col("o.o_totalprice").alias("best"))


# --- writes


def _numbers(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "part").select("p_partkey", "p_size", F.col("p_brand").alias("a"), F.lit(None).cast("string").alias("b"), F.array(F.col("p_size"), F.col("p_size") + 1, F.col("p_size") + 2).alias("x"))


@query("select p_partkey, least(p_size, 10) | 1 p_size, null::varchar a, p_brand b from part")
def update_min_bit_rename(s, d):
    w = Writer(_numbers(s, d), "p_partkey").update_many(Filters.all(), {"$min": {"p_size": 10}, "$rename": {"a": "b"}})
    return Writer(w, "p_partkey").update_many(Filters.all(), {"$bit": {"p_size": {"or": 1}}}).select("p_partkey", "p_size", "a", "b")


@query("select p_partkey, greatest(p_size, 20) p_size, true now from part")
def update_max_date(s, d):
    df = _numbers(s, d).withColumn("at", F.lit(datetime(2000, 1, 1)).cast("timestamp"))
    out = Writer(df, "p_partkey").update_many(Filters.all(), {"$max": {"p_size": 20}, "$currentDate": {"at": True}})
    return out.select("p_partkey", "p_size", (F.col("at") > F.lit("2020-01-01").cast("timestamp")).alias("now"))


@query("select p_partkey, p_size::varchar || ',' || (p_size + 1) a, (p_size + 1)::varchar || ',' || (p_size + 2) b, array_to_string(list_sort([p_size, p_size + 1, p_size + 2, 9, 3], 'DESC')[1:3], ',') c, case when p_size in (4, 5) then 2 else 3 end::bigint n from part")
def update_pop_push_pull(s, d):
    run = lambda change: Writer(_numbers(s, d), "p_partkey").update_many(Filters.all(), change).select("p_partkey", "x")
    text = lambda df, name: df.select("p_partkey", F.array_join(F.col("x").cast("array<string>"), ",").alias(name))
    out = text(run({"$pop": {"x": 1}}), "a").join(text(run({"$pop": {"x": -1}}), "b"), "p_partkey")
    out = out.join(text(run({"$push": {"x": {"$each": [9, 3], "$sort": -1, "$slice": 3}}}), "c"), "p_partkey")
    own = Writer(_numbers(s, d).withColumn("x", F.array("p_size", F.lit(100), F.lit(101))), "p_partkey").update_many(Filters.all(), {"$pullAll": {"x": [4, 5]}})
    return out.join(own.select("p_partkey", F.size("x").cast("bigint").alias("n")), "p_partkey")


@query("select p_partkey, case when p_size > 25 then p_size * 2 else p_size end p_size, case when p_size > 25 then 'big' else p_brand end a from part")
def update_pipeline(s, d):
    w = Writer(_numbers(s, d), "p_partkey")
    out = w.update_many({"p_size": {"$gt": 25}}, lambda p: p.set(lambda f: {"p_size": fn.multiply(f.p_size, 2), "a": fn.literal("big")}))
    return out.select("p_partkey", F.col("p_size").cast("int").alias("p_size"), "a")


@query("select p_partkey, case when p_partkey = 7 then 0 else p_size end p_size from part where p_partkey not in (3, 4) union all select 1000000, 1 union all select 1000001, 2")
def bulk_write(s, d):
    df = _table(s, d, "part").select("p_partkey", "p_size")
    commands = [{"deleteOne": {"filter": {"p_partkey": 3}}}, {"deleteMany": {"filter": {"p_partkey": 4}}}, {"updateOne": {"filter": {"p_partkey": 7}, "update": {"$set": {"p_size": 0}}}}, {"explode": {}}, {"insertOne": {"document": {"p_partkey": 1_000_000, "p_size": 1}}}]
    out = Writer(df, "p_partkey").bulk_write(commands, ordered=False)
    return Writer(out, "p_partkey").create([{"p_partkey": 1_000_001, "p_size": 2}])


@query("select p_partkey, case when p_partkey in (2, 5) then 99 else p_size end p_size from part union all select 1000000, 1")
def bulk_save(s, d):
    df = _table(s, d, "part").select("p_partkey", "p_size")
    return Writer(df, "p_partkey").bulk_save([{"p_partkey": 2, "p_size": 99}, {"p_partkey": 5, "p_size": 99}], new=[{"p_partkey": 1_000_000, "p_size": 1}])


@query("select 'update' step, p_partkey, p_size from part where p_partkey = 3 union all select 'replace', 3, 50 union all select 'delete', p_partkey, p_size from part where p_partkey = 3 union all select 'left', null, count(*)::int - 1 from part")
def find_one_and(s, d):
    w = Writer(_table(s, d, "part").select("p_partkey", "p_size"), "p_partkey")
    before, _ = w.find_one_and_update({"p_partkey": 3}, {"$set": {"p_size": 1}})
    after, _ = w.find_one_and_replace({"p_partkey": 3}, {"p_size": 50}, after=True)
    gone, rest = w.find_one_and_delete({"p_partkey": 3})
    left = rest.agg(F.lit(None).cast("bigint").alias("p_partkey"), F.count(F.lit(1)).cast("int").alias("p_size"))
    out = before.select(F.lit("update").alias("step"), "p_partkey", "p_size")
    for name, df in (("replace", after), ("delete", gone), ("left", left)):
        out = out.unionByName(df.select(F.lit(name).alias("step"), "p_partkey", "p_size"))
    return out


@query("select o_orderstatus, count(*) n, count(*) n2 from orders group by 1")
def materialized_view(s, d):
    build = lambda s: _t(s, d, "orders").group(lambda f: {"_id": f.o_orderstatus, "n": fn.count()})
    m = Materialized(scratch_path(s, "materialized"), build, ["_id"])
    m.refresh(s)
    view = View("order_counts", build)
    found = view.aggregate(s, lambda p: p.project(lambda f: {"_id": 1, "n2": f.n})).df
    return m.refresh(s).join(found, "_id").select(F.col("_id").alias("o_orderstatus"), "n", "n2")


@query("select count(distinct o_orderstatus) n, count(distinct o_orderstatus) names, 1::bigint one from orders")
def view_reads(s, d):
    view = View("order_counts", lambda s: _t(s, d, "orders").group(lambda f: {"_id": f.o_orderstatus, "n": fn.count()}))
    return s.createDataFrame([(view.count(s), view.distinct(s, "_id").count(), view.find_one(s, {"n": {"$gt": 0}}).count())], "n long, names long, one long")


# --- change events


def _log(s: SparkSession, d: str) -> DataFrame:
    """Every part inserted; those with a key divisible by 3 updated, by 5 deleted afterwards."""
    docs = _table(s, d, "part").select(F.col("p_partkey").alias("_id"), "p_size", "p_brand")
    now = F.struct(*docs.columns)
    kind = docs.select(now.alias("x")).schema[0].dataType
    event = lambda op, day, before, after: (F.lit(op).alias("op"), F.lit(f"2024-01-0{day}").cast("timestamp").alias("ts"), F.col("_id").alias("key"), before.alias("before"), after.alias("after"))
    none = F.lit(None).cast(kind)
    changed = F.struct(F.col("_id"), (F.col("p_size") + 1).alias("p_size"), F.lit(None).cast("string").alias("p_brand"))
    out = docs.select(*event("insert", 1, none, now)).unionByName(docs.where("_id % 3 = 0").select(*event("update", 2, now, changed)))
    out = out.unionByName(docs.where("_id % 5 = 0").select(*event("delete", 3, now, none)))
    return s.createDataFrame([], log_schema(docs.schema)).unionByName(out)


@query("select p_partkey as _id, case when p_partkey % 3 = 0 then p_size + 1 else p_size end p_size from part where p_partkey % 5 <> 0")
def apply_change_log(s, d):
    log = _log(s, d)
    return apply_changes(log.limit(0).select("after.*"), log).select("_id", "p_size")


@query("""select p_partkey as _id, 'insert' op, null updated, null removed, p_size after, null::int before from part union all
 select p_partkey, 'update', 'p_size', 'p_brand', p_size + 1, p_size from part where p_partkey % 3 = 0 union all select p_partkey, 'delete', null, null, null, p_size from part where p_partkey % 5 = 0""")
def change_events(s, d):
    e = shape_events(_log(s, d), full_document="updateLookup", full_document_before_change="whenAvailable", hidden=["p_brand"])
    join = lambda c: F.array_join(F.col(f"updateDescription.{c}"), ",")
    return e.select(F.col("documentKey._id").alias("_id"), F.col("operationType").alias("op"), join("updatedFields").alias("updated"), join("removedFields").alias("removed"), F.col("fullDocument.p_size").alias("after"), F.col("fullDocumentBeforeChange.p_size").alias("before"))


@query("select p_partkey as _id from part where p_partkey % 5 = 0")
def change_stream_stage(s, d):
    p = Pipeline.watch(_log(s, d)).change_stream(start_at=datetime(2024, 1, 3)).change_stream_split_large_event()
    return p.match({"operationType": "delete"}).project(lambda f: {"_id": f["documentKey._id"]}).df
