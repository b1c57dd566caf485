"""Named queries over the star schema and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fn
from ..functions.core import REMOVE
from ..operators.filters import Where
from ..operators.pipeline import Pipeline
from ..operators.query import Collection, Policies, populate, populate_virtual
from ..operators.update import Writer
from ..sources.collections import merged
from ..sources.scratch import scratch_path
from ..streaming.change_log import log_schema, watch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _t(s: SparkSession, d: str, name: str) -> Pipeline:
    return Pipeline.read(s, f"{d}/{name}.parquet")


def _r(x: Column, n: int = 4) -> Column:
    return F.round(x.cast("double"), n)


def _items(s: SparkSession, d: str) -> Pipeline:
    """Orders with their lines as an array of documents."""
    lines = s.read.parquet(f"{d}/lineitem.parquet")
    doc = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))
    return Pipeline(lines.groupBy(F.col("l_orderkey").alias("_id")).agg(F.array_sort(F.collect_list(doc)).alias("items")))


_ITEMS = "(select l_orderkey _id, list({line: l_linenumber, part: l_partkey, qty: l_quantity, price: l_extendedprice} order by l_linenumber, l_partkey, l_quantity, l_extendedprice) items from lineitem group by 1)"


def _n(x: Column, n: int) -> Column:
    """Rounded away from ties, which depend on the order of summation."""
    return F.round(x.cast("double") + 1.3 * 10.0 ** -(n + 1), n)


def flagship(s: SparkSession, d: str) -> DataFrame:
    p = _t(s, d, "lineitem").match({"l_shipdate": {"$lte": datetime(1998, 9, 2)}})
    p = p.add_fields(lambda f: {"revenue": fn.multiply(f.l_extendedprice, fn.subtract(1, f.l_discount))})
    p = p.group(lambda f: {"_id": {"flag": f.l_returnflag, "status": f.l_linestatus}, "quantity": fn.sum(f.l_quantity), "revenue": fn.sum(f.revenue), "avg_discount": fn.avg(f.l_discount), "n": fn.count()})
    p = p.project(lambda f: {"_id": 0, "flag": f["_id.flag"], "status": f["_id.status"], "quantity": _r(f.quantity), "revenue": _r(f.revenue, 2), "avg_discount": _r(f.avg_discount, 6), "n": 1})
    return p.sort({"flag": 1, "status": 1}).df


@query("select l_returnflag flag, l_linestatus status, round(sum(l_quantity), 4) quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) avg_discount, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(s, d):
    return flagship(s, d)


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 25")
def match_sort_limit(s, d):
    return _t(s, d, "orders").match({"o_orderstatus": "O"}).sort({"o_totalprice": -1, "o_orderkey": 1}).limit(25).project({"o_orderkey": 1, "o_totalprice": 1}).df


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_quantity * l_discount > 2 and l_tax < 0.02")
def match_expr(s, d):
    p = _t(s, d, "lineitem").match(lambda f: fn.and_(fn.gt(fn.multiply(f.l_quantity, f.l_discount), 2), fn.lt(f.l_tax, 0.02)))
    return p.project({"l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1}).df


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where (l_quantity > 45 or l_discount >= 0.09) and not (l_returnflag = 'A' or l_linestatus = 'F')")
def filter_logic(s, d):
    spec = {"$or": [{"l_quantity": {"$gt": 45}}, {"l_discount": {"$gte": 0.09}}], "$nor": [{"l_returnflag": "A"}, {"l_linestatus": "F"}]}
    return _t(s, d, "lineitem").match(spec).project({"l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1}).df


@query("select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey not in (1, 2, 3)")
def filter_in_nin(s, d):
    return _t(s, d, "customer").match({"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}, "c_nationkey": {"$nin": [1, 2, 3]}}).project({"c_custkey": 1}).df


@query("select p_partkey, p_name from part where regexp_matches(p_name, '(?i)^RED.*[a-m]$')")
def filter_regex(s, d):
    return _t(s, d, "part").match({"p_name": {"$regex": "^Red.*[a-m]$", "$options": "i"}}).project({"p_partkey": 1, "p_name": 1}).df


@query("select o_orderkey from orders where o_orderkey % 7 = 3")
def filter_mod(s, d):
    return _t(s, d, "orders").match({"o_orderkey": {"$mod": [7, 3]}}).project({"o_orderkey": 1}).df


@query("select p_partkey, p_size from part where (p_size & 5) = 5 and (p_size & 8) = 0 and (p_size & 48) <> 0")
def filter_bits(s, d):
    return _t(s, d, "part").match({"p_size": {"$bitsAllSet": [0, 2], "$bitsAllClear": 8, "$bitsAnySet": 48}}).project({"p_partkey": 1, "p_size": 1}).df


_NULLS = "(select event_id, case when event_id % 7 = 0 then null else value end v from events)"


@query(f"select event_id from {_NULLS} where v is distinct from 10 and (v is null or v not in (1, 2)) and not coalesce(v > 50, false)")
def filter_null_semantics(s, d):
    p = _t(s, d, "events").project(lambda f: {"event_id": 1, "v": F.when(f.event_id % 7 != 0, f.value)})
    return p.match({"v": {"$ne": 10, "$nin": [1, 2], "$not": {"$gt": 50}}}).project({"event_id": 1}).df


@query(f"select event_id from {_NULLS} where v is null")
def filter_null_equals(s, d):
    p = _t(s, d, "events").project(lambda f: {"event_id": 1, "v": F.when(f.event_id % 7 != 0, f.value)})
    return p.match({"v": None, "event_id": {"$exists": True, "$type": "long"}}).project({"event_id": 1}).df


@query(f"select _id from {_ITEMS} where len(list_filter(items, lambda x: x.qty > 40 and x.line = 1)) > 0")
def filter_elem_match(s, d):
    return _items(s, d).match({"items": {"$elemMatch": {"qty": {"$gt": 40}, "line": 1}}}).project({"_id": 1}).df


@query(f"select _id from {_ITEMS} where list_has_all(list_transform(items, lambda x: x.line), [1, 2]) and len(items) = 4")
def filter_all_size(s, d):
    p = _items(s, d).add_fields(lambda f: {"lines": fn.map(f.items, lambda x: x["line"])})
    return p.match({"lines": {"$all": [1, 2], "$size": 4}}).project({"_id": 1}).df


@query(f"select _id from {_ITEMS} where len(list_filter(items, lambda x: x.price > 50000)) > 0")
def filter_path_through_array(s, d):
    return _items(s, d).match({"items.price": {"$gt": 50000}}).project({"_id": 1}).df


@query("select p_partkey from part where p_size >= 10 and p_size < 12 and p_brand is not null and length(p_name) >= 5")
def filter_json_schema(s, d):
    own = {"$jsonSchema": {"required": ["p_brand"], "properties": {"p_size": {"bsonType": "int", "minimum": 10, "maximum": 11}, "p_name": {"minLength": 5}}}}
    return _t(s, d, "part").match(own).project({"p_partkey": 1}).df


@query("select p_partkey from part where p_size > 10 and p_size <= 20 and p_size <> 15")
def where_chain(s, d):
    return _t(s, d, "part").match(Where("p_size").gt(10).lte(20).ne(15).spec()).project({"p_partkey": 1}).df


@query("select o_orderkey from orders order by o_totalprice, o_orderkey limit 20 offset 30")
def paging_skip(s, d):
    return _t(s, d, "orders").sort({"o_totalprice": 1, "o_orderkey": 1}).skip(30).limit(20).project({"o_orderkey": 1}).df


@query("select o_orderkey, o_orderstatus from (select *, row_number() over (order by o_orderstatus desc, o_orderkey) n from orders) where n between 11 and 21")
def keyset_page(s, d):
    q = Collection(s.read.parquet(f"{d}/orders.parquet"), "o_orderkey").find().sort([("o_orderstatus", -1)])
    rows, token = q.keyset_page(10, key="o_orderkey")
    after = token(rows.collect())
    return q.keyset_page(10, after, key="o_orderkey")[0].select("o_orderkey", "o_orderstatus")


@query("select count(*) n from orders where o_orderstatus = 'F' having count(*) > 0")
def count_stage(s, d):
    return _t(s, d, "orders").match({"o_orderstatus": "F"}).count("n").df


@query("select count(*) n from orders where o_orderkey < 0 having count(*) > 0")
def count_empty(s, d):
    return _t(s, d, "orders").match({"o_orderkey": {"$lt": 0}}).count("n").df


@query("select c_custkey _id, c_name, 'x' tag from customer")
def project_include(s, d):
    p = _t(s, d, "customer").add_fields(lambda f: {"_id": f.c_custkey, "tag": fn.literal("x")})
    return p.project({"c_name": 1, "tag": 1}).df


@query("select c_custkey, c_name, c_nationkey from customer")
def project_exclude(s, d):
    return _t(s, d, "customer").project({"c_acctbal": 0, "c_mktsegment": 0}).df


@query("select c_custkey, round(c_acctbal * 2, 2) twice, upper(c_name) up from customer")
def project_computed(s, d):
    return _t(s, d, "customer").project(lambda f: {"c_custkey": 1, "twice": _r(fn.multiply(f.c_acctbal, 2), 2), "up": fn.to_upper(f.c_name)}).df


@query("select c_custkey, c_nationkey nation, c_nationkey + 1 plus from customer")
def add_fields_nested(s, d):
    p = _t(s, d, "customer").add_fields(lambda f: {"where.nation": f.c_nationkey}).set(lambda f: {"where.plus": fn.add(f["where.nation"], 1)})
    return p.project(lambda f: {"c_custkey": 1, "nation": f["where.nation"], "plus": f["where.plus"]}).df


@query("select c_custkey, c_name from customer")
def unset(s, d):
    p = _t(s, d, "customer").unset(["c_acctbal", "c_mktsegment"]).add_fields({"c_nationkey": REMOVE})
    return p.df


@query("select c_custkey k, c_name n from customer")
def replace_root(s, d):
    return _t(s, d, "customer").replace_root(lambda f: {"k": f.c_custkey, "n": f.c_name}).df


@query("select o_orderkey from orders where o_totalprice > 200000")
def redact_prune(s, d):
    return _t(s, d, "orders").redact(lambda f: fn.cond(fn.gt(f.o_totalprice, 200000), fn.keep(), fn.prune())).project({"o_orderkey": 1}).df


@query(f"select _id, cast(len(list_filter(items, lambda x: x.qty > 10)) as bigint) n from {_ITEMS}")
def redact_descend(s, d):
    p = _items(s, d).add_fields(lambda f: {"qty": fn.literal(11.0)}).redact(lambda f: fn.cond(fn.gt(f.qty, 10), fn.descend(), fn.prune()))
    return p.project(lambda f: {"_id": 1, "n": fn.size(f.items).cast("bigint")}).df


@query("select l_orderkey _id, l_linenumber line, l_quantity qty from lineitem")
def unwind(s, d):
    return _items(s, d).unwind("$items").project(lambda f: {"_id": 1, "line": f["items.line"], "qty": f["items.qty"]}).df


@query(f"select _id, unnest(list_transform(items, lambda x: x.part)) part, unnest(range(len(items))) pos from {_ITEMS}")
def unwind_index(s, d):
    return _items(s, d).unwind("items", include_array_index="pos").project(lambda f: {"_id": 1, "part": f["items.part"], "pos": 1}).df


@query(f"select _id, coalesce(x.line, -1) line, x is not null has from (select _id, unnest(case when len(list_filter(items, lambda x: x.qty > 45)) = 0 then [null] else list_filter(items, lambda x: x.qty > 45) end) x from {_ITEMS})")
def unwind_preserve(s, d):
    p = _items(s, d).add_fields(lambda f: {"items": fn.filter(f.items, lambda x: x["qty"] > 45)})
    p = p.unwind("items", preserve_null_and_empty_arrays=True)
    return p.project(lambda f: {"_id": 1, "line": fn.if_null(f["items.line"], -1), "has": f["items"].isNotNull()}).df


@query("select l_returnflag flag, sum(l_quantity) qty, round(avg(l_extendedprice), 4) mean, min(l_tax) low, max(l_tax) high, count(*) n from lineitem group by 1")
def group_basic(s, d):
    p = _t(s, d, "lineitem").group(lambda f: {"_id": f.l_returnflag, "qty": fn.sum(f.l_quantity), "mean": fn.avg(f.l_extendedprice), "low": fn.min(f.l_tax), "high": fn.max(f.l_tax), "n": fn.count()})
    return p.project(lambda f: {"_id": 0, "flag": f["_id"], "qty": 1, "mean": _r(f.mean), "low": 1, "high": 1, "n": 1}).df


@query("select o_orderstatus status, year(o_orderdate)::int y, count(*) n, round(sum(o_totalprice), 2) total from orders group by all")
def group_composite(s, d):
    p = _t(s, d, "orders").group(lambda f: {"_id": {"status": f.o_orderstatus, "y": fn.year(f.o_orderdate)}, "n": fn.count(), "total": fn.sum(f.o_totalprice)})
    return p.project(lambda f: {"_id": 0, "status": f["_id.status"], "y": f["_id.y"], "n": 1, "total": _r(f.total, 2)}).df


@query("select count(*) n, round(sum(o_totalprice), 2) total from orders")
def group_null_key(s, d):
    p = _t(s, d, "orders").group(lambda f: {"_id": None, "n": fn.count(), "total": fn.sum(f.o_totalprice)})
    return p.project(lambda f: {"_id": 0, "n": 1, "total": _r(f.total, 2)}).df


@query("select o_custkey k, arg_min(o_orderkey, (o_orderdate, o_orderkey)) a, arg_max(o_orderkey, (o_orderdate, o_orderkey)) b from orders group by 1")
def group_first_last(s, d):
    p = _t(s, d, "orders").sort({"o_orderdate": 1, "o_orderkey": 1}).group(lambda f: {"_id": f.o_custkey, "a": fn.first(f.o_orderkey), "b": fn.last(f.o_orderkey)})
    return p.project(lambda f: {"_id": 0, "k": f["_id"], "a": 1, "b": 1}).df


@query("select o_custkey k, string_agg(cast(o_orderkey as varchar), ',' order by o_totalprice desc, o_orderkey) ids from orders group by 1")
def group_push(s, d):
    p = _t(s, d, "orders").sort({"o_totalprice": -1, "o_orderkey": 1}).group(lambda f: {"_id": f.o_custkey, "ids": fn.push(f.o_orderkey)})
    return p.project(lambda f: {"_id": 0, "k": f["_id"], "ids": F.array_join(f.ids.cast("array<string>"), ",")}).df


@query("select o_custkey k, array_to_string(list_sort(list(distinct o_orderstatus)), ',') st from orders group by 1")
def group_add_to_set(s, d):
    p = _t(s, d, "orders").group(lambda f: {"_id": f.o_custkey, "st": fn.add_to_set(f.o_orderstatus)})
    return p.project(lambda f: {"_id": 0, "k": f["_id"], "st": F.array_join(f.st, ",")}).df


@query("select o_custkey k, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) best, arg_min(o_orderkey, (o_totalprice, -o_orderkey)) worst from orders group by 1")
def group_top(s, d):
    by = [("o_totalprice", -1), ("o_orderkey", 1)]
    p = _t(s, d, "orders").group(lambda f: {"_id": f.o_custkey, "best": fn.top(f.o_orderkey, by), "worst": fn.bottom(f.o_orderkey, by)})
    return p.project(lambda f: {"_id": 0, "k": f["_id"], "best": 1, "worst": 1}).df


_RANKED = "(select o_custkey k, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) n, count(*) over (partition by o_custkey) m from orders)"


@query(f"select k, string_agg(o_orderkey::varchar, ',' order by n) filter (n <= 3) a, string_agg(o_orderkey::varchar, ',' order by n) filter (n > m - 2) b from {_RANKED} group by 1")
def group_topn(s, d):
    by = {"o_totalprice": -1, "o_orderkey": 1}
    p = _t(s, d, "orders").group(lambda f: {"_id": f.o_custkey, "a": fn.top_n(f.o_orderkey, by, 3), "b": fn.bottom_n(f.o_orderkey, by, 2)})
    return p.project(lambda f: {"_id": 0, "k": f["_id"], "a": F.array_join(f.a.cast("array<string>"), ","), "b": F.array_join(f.b.cast("array<string>"), ",")}).df


@query(f"select k, string_agg(o_orderkey::varchar, ',' order by n) filter (n <= 2) a, string_agg(o_orderkey::varchar, ',' order by n) filter (n > m - 3) b from {_RANKED} group by 1")
def group_firstn(s, d):
    p = _t(s, d, "orders").sort({"o_totalprice": -1, "o_orderkey": 1}).group(lambda f: {"_id": f.o_custkey, "a": fn.first_n(f.o_orderkey, 2), "b": fn.last_n(f.o_orderkey, 3)})
    return p.project(lambda f: {"_id": 0, "k": f["_id"], "a": F.array_join(f.a.cast("array<string>"), ","), "b": F.array_join(f.b.cast("array<string>"), ",")}).df


@query("select p_brand k, array_to_string(list_sort(list(p_size), 'DESC')[1:3], ',') a, array_to_string(list_sort(list(p_size))[1:2], ',') b from part group by 1")
def group_maxn(s, d):
    p = _t(s, d, "part").group(lambda f: {"_id": f.p_brand, "a": fn.max_n(f.p_size, 3), "b": fn.min_n(f.p_size, 2)})
    return p.project(lambda f: {"_id": 0, "k": f["_id"], "a": F.array_join(f.a.cast("array<string>"), ","), "b": F.array_join(f.b.cast("array<string>"), ",")}).df


@query("select l_returnflag k, round(stddev_pop(l_quantity), 4) a, round(stddev_samp(l_tax), 6) b from lineitem group by 1")
def group_stddev(s, d):
    p = _t(s, d, "lineitem").group(lambda f: {"_id": f.l_returnflag, "a": fn.std_dev_pop(f.l_quantity), "b": fn.std_dev_samp(f.l_tax)})
    return p.project(lambda f: {"_id": 0, "k": f["_id"], "a": _r(f.a), "b": _r(f.b, 6)}).df


@query("select l_returnflag k, quantile_disc(l_quantity, 0.5) m, quantile_disc(l_quantity, 0.25) a, quantile_disc(l_quantity, 0.9) b from lineitem group by 1")
def group_percentile(s, d):
    p = _t(s, d, "lineitem").group(lambda f: {"_id": f.l_returnflag, "m": fn.median(f.l_quantity), "p": fn.percentile(f.l_quantity, [0.25, 0.9])})
    return p.project(lambda f: {"_id": 0, "k": f["_id"], "m": 1, "a": f.p[0], "b": f.p[1]}).df


@query("select user_id k, arg_max(event_type, event_id) t, arg_max(value, event_id) v from events group by 1")
def merge_objects_acc(s, d):
    p = _t(s, d, "events").sort({"event_id": 1}).group(lambda f: {"_id": f.user_id, "o": fn.merge_objects(F.struct(f.event_type.alias("t"), f.value.alias("v")))})
    return p.project(lambda f: {"_id": 0, "k": f["_id"], "t": f["o.t"], "v": f["o.v"]}).df


@query("select user_id k, count(*) * 2 n, string_agg(event_type || ',' || user_id, ',' order by event_id) a, count(distinct event_type) + 1 u from events group by 1")
def concat_arrays_acc(s, d):
    both = lambda f: F.array(f.event_type, f.user_id.cast("string"))
    p = _t(s, d, "events").sort({"event_id": 1}).group(lambda f: {"_id": f.user_id, "a": fn.concat_arrays(both(f)), "u": fn.set_union(both(f))})
    return p.project(lambda f: {"_id": 0, "k": f["_id"], "n": fn.size(f.a).cast("bigint"), "a": F.array_join(f.a, ","), "u": fn.size(f.u).cast("bigint")}).df


@query("select case when p_size < 10 then 0 when p_size < 25 then 10 else 25 end lo, count(*) n, round(sum(p_retailprice), 2) total from part group by 1")
def bucket(s, d):
    p = _t(s, d, "part").bucket(lambda f: f.p_size, [0, 10, 25, 100], output=lambda f: {"n": fn.count(), "total": fn.sum(f.p_retailprice)})
    return p.project(lambda f: {"_id": 0, "lo": f["_id"], "n": 1, "total": _r(f.total, 2)}).df


@query("select case when p_size >= 10 and p_size < 20 then 10 else -1 end lo, count(*) n from part group by 1")
def bucket_default(s, d):
    return _t(s, d, "part").bucket(lambda f: f.p_size, [10, 20], default=-1).project(lambda f: {"_id": 0, "lo": f["_id"], "n": f["count"]}).df


@query("""with c as (select p_size k, count(*) n from part group by 1), b as (select *, coalesce(sum(n) over (order by k rows between unbounded preceding and 1 preceding), 0) p, sum(n) over () t from c),
 g as (select *, least(floor(p / greatest(round(t / 4), 1)), 3) g from b), o as (select g, min(k) lo, max(k) hi, sum(n) n from g group by 1)
 select lo, coalesce(lead(lo) over (order by g), hi) hi, n::bigint n from o""")
def bucket_auto(s, d):
    p = _t(s, d, "part").bucket_auto(lambda f: f.p_size, 4)
    return p.project(lambda f: {"_id": 0, "lo": f["_id.min"], "hi": f["_id.max"], "n": f["count"]}).df


@query("select c_mktsegment k, count(*) n from customer group by 1")
def sort_by_count(s, d):
    return _t(s, d, "customer").sort_by_count(lambda f: f.c_mktsegment).project(lambda f: {"_id": 0, "k": f["_id"], "n": f["count"]}).df


def _window(s, d, output, sort_by, keep=("o_orderkey",), part="o_custkey", table="orders"):
    p = _t(s, d, table).set_window_fields(output, partition_by=None if part is None else (lambda f: f[part]), sort_by=sort_by)
    return p, dict.fromkeys(keep, 1)


@query("select o_orderkey, rank() over w r, dense_rank() over w dr, row_number() over (partition by o_custkey order by o_orderkey) n from orders window w as (partition by o_custkey order by o_orderstatus)")
def window_rank(s, d):
    p, keep = _window(s, d, {"r": fn.rank(), "dr": fn.dense_rank()}, {"o_orderstatus": 1})
    p = p.set_window_fields({"n": fn.document_number()}, lambda f: f.o_custkey, {"o_orderkey": 1})
    return p.project(lambda f: keep | {k: f[k].cast("bigint") for k in ("r", "dr", "n")}).df


@query("select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), 2) x, round(sum(o_totalprice) over (partition by o_custkey), 2) total from orders")
def window_running_sum(s, d):
    p, keep = _window(s, d, lambda f: {"x": fn.with_window(fn.sum(f.o_totalprice), documents=["unbounded", "current"]), "total": fn.sum(f.o_totalprice)}, {"o_orderdate": 1, "o_orderkey": 1})
    return p.project(lambda f: keep | {"x": _r(f.x, 2), "total": _r(f.total, 2)}).df


@query("select event_id, round(avg(value) over (partition by user_id order by event_id rows between 2 preceding and current row), 4) x from events")
def window_moving_avg(s, d):
    p, _ = _window(s, d, lambda f: {"x": fn.with_window(fn.avg(f.value), documents=[-2, "current"])}, {"event_id": 1}, part="user_id", table="events")
    return p.project(lambda f: {"event_id": 1, "x": _r(f.x)}).df


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 3 day preceding and current row) n from events")
def window_range_days(s, d):
    p, _ = _window(s, d, {"n": fn.with_window(fn.count(), range=[-3, "current"], unit="day")}, {"ts": 1}, part="user_id", table="events")
    return p.project({"event_id": 1, "n": 1}).df


@query("select event_id, lag(value) over w a, lead(value, 2, 0.0) over w b from events window w as (partition by user_id order by event_id)")
def window_shift(s, d):
    p, _ = _window(s, d, lambda f: {"a": fn.shift(f.value, -1), "b": fn.shift(f.value, 2, 0.0)}, {"event_id": 1}, part="user_id", table="events")
    return p.project({"event_id": 1, "a": 1, "b": 1}).df


@query("""with recursive e as (select *, row_number() over (partition by user_id order by event_id) n from events), r as (select user_id, event_id, n, value x from e where n = 1
 union all select e.user_id, e.event_id, e.n, e.value * 0.5 + r.x * 0.5 from r join e on e.user_id = r.user_id and e.n = r.n + 1) select event_id, round(x + 0.000013, 4) x from r""")
def window_ema(s, d):
    p, _ = _window(s, d, lambda f: {"x": fn.exp_moving_avg(f.value, n=3)}, {"event_id": 1}, part="user_id", table="events")
    return p.project(lambda f: {"event_id": 1, "x": _n(f.x, 4)}).df


_FRAME3 = "window w as (partition by user_id order by event_id rows between 1 preceding and 1 following)"


@query(f"select event_id, round(case when count(*) over w > 1 then (last(value) over w - first(value) over w) / (last(event_id) over w - first(event_id) over w) end + 0.00000013, 6) x from events {_FRAME3}")
def window_derivative(s, d):
    p, _ = _window(s, d, lambda f: {"x": fn.with_window(fn.derivative(f.value), documents=[-1, 1])}, {"event_id": 1}, part="user_id", table="events")
    return p.project(lambda f: {"event_id": 1, "x": _n(f.x, 6)}).df


@query("""with a as (select *, coalesce((value + lag(value) over w) / 2 * (event_id - lag(event_id) over w), 0) t from events window w as (partition by user_id order by event_id)),
 c as (select *, sum(t) over (partition by user_id order by event_id rows unbounded preceding) c from a)
 select event_id, round(last(c) over w - first(c) over w + 0.0013, 2) x from c window w as (partition by user_id order by event_id rows between 3 preceding and current row)""")
def window_integral(s, d):
    p, _ = _window(s, d, lambda f: {"x": fn.with_window(fn.integral(f.value), documents=[-3, "current"])}, {"event_id": 1}, part="user_id", table="events")
    return p.project(lambda f: {"event_id": 1, "x": _n(f.x, 2)}).df


_GAPS = "(select event_id, user_id, case when event_id % 3 = 0 then value end v from events)"


def _gaps(s, d):
    return _t(s, d, "events").project(lambda f: {"event_id": 1, "user_id": 1, "v": F.when(f.event_id % 3 == 0, f.value)})


@query(f"select event_id, last(v ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) x from {_GAPS}")
def window_locf(s, d):
    p = _gaps(s, d).set_window_fields(lambda f: {"x": fn.locf(f.v)}, lambda f: f.user_id, {"event_id": 1})
    return p.project({"event_id": 1, "x": 1}).df


_LINEAR = f"""(select event_id, user_id, v, last(v ignore nulls) over b x0, last(case when v is not null then event_id end ignore nulls) over b k0, first(v ignore nulls) over a x1,
 first(case when v is not null then event_id end ignore nulls) over a k1 from {_GAPS} window b as (partition by user_id order by event_id rows unbounded preceding), a as (partition by user_id order by event_id rows between current row and unbounded following))"""


@query(f"select event_id, round(coalesce(v, x0 + (x1 - x0) * (event_id - k0) / (k1 - k0)) + 0.000013, 4) x from {_LINEAR}")
def window_linear_fill(s, d):
    p = _gaps(s, d).set_window_fields(lambda f: {"x": fn.linear_fill(f.v)}, lambda f: f.user_id, {"event_id": 1})
    return p.project(lambda f: {"event_id": 1, "x": _n(f.x, 4)}).df


@query("select event_id, round((value - min(value) over w) / nullif(max(value) over w - min(value) over w, 0) * 10 + 5, 4) x from events window w as (partition by user_id)")
def window_minmax_scaler(s, d):
    p, _ = _window(s, d, lambda f: {"x": fn.min_max_scaler(f.value, 5, 15)}, None, part="user_id", table="events")
    return p.project(lambda f: {"event_id": 1, "x": _r(f.x)}).df


@query("select event_id, round(covar_pop(value, event_id) over w, 2) a, round(covar_samp(value, event_id) over w, 2) b from events window w as (partition by user_id)")
def window_covariance(s, d):
    p, _ = _window(s, d, lambda f: {"a": fn.covariance_pop(f.value, f.event_id), "b": fn.covariance_samp(f.value, f.event_id)}, None, part="user_id", table="events")
    return p.project(lambda f: {"event_id": 1, "a": _r(f.a, 2), "b": _r(f.b, 2)}).df


_DAYS = "(select user_id, date_trunc('day', ts) d, round(sum(value), 2) total from events group by all)"


@query(f"""with h as {_DAYS}, t as (select user_id, min(d) a, max(d) b from h group by 1), r as (select user_id, unnest(generate_series(a, b, interval 1 day)) d from t)
 select r.user_id, r.d, coalesce(h.total, -1) total from r left join h on h.user_id = r.user_id and h.d = r.d""")
def densify_days(s, d):
    p = _t(s, d, "events").group(lambda f: {"_id": {"u": f.user_id, "day": fn.date_trunc(f.ts, "day")}, "total": fn.sum(f.value)})
    p = p.project(lambda f: {"_id": 0, "user_id": f["_id.u"], "d": f["_id.day"], "total": _r(f.total, 2)})
    return p.densify("d", 1, "day", "partition", ["user_id"]).fill({"total": {"value": -1.0}}).df


_HOURS = "(select event_type, date_trunc('hour', ts) d, round(sum(value), 2) total from events group by all)"


@query(f"""with h as {_HOURS}, t as (select event_type, min(d) a, max(d) b from h group by 1), r as (select event_type, unnest(generate_series(a, b, interval 1 hour)) d from t)
 select r.event_type, r.d, coalesce(h.total, -1) total from r left join h on h.event_type = r.event_type and h.d = r.d""")
def densify_hours(s, d):
    p = _t(s, d, "events").group(lambda f: {"_id": {"t": f.event_type, "hour": fn.date_trunc(f.ts, "hour")}, "total": fn.sum(f.value)})
    p = p.project(lambda f: {"_id": 0, "event_type": f["_id.t"], "d": f["_id.hour"], "total": _r(f.total, 2)})
    return p.densify("d", 1, "hour", "partition", ["event_type"]).fill({"total": {"value": -1.0}}).df


@query("select distinct k from (select p_size k from part where p_size % 5 = 0 union all select unnest(range(2, 30, 3)))")
def densify_number(s, d):
    p = _t(s, d, "part").match({"p_size": {"$mod": [5, 0]}}).project(lambda f: {"k": f.p_size.cast("bigint")})
    return p.densify("k", 3, bounds=[2, 30]).group(lambda f: {"_id": f.k}).project(lambda f: {"_id": 0, "k": f["_id"]}).df


@query(f"select event_id, coalesce(v, user_id) x from {_GAPS}")
def fill_value(s, d):
    return _gaps(s, d).fill({"v": {"value": lambda f: f.user_id.cast("double")}}).project(lambda f: {"event_id": 1, "x": f.v}).df


@query(f"select event_id, last(v ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) x from {_GAPS}")
def fill_locf(s, d):
    return _gaps(s, d).fill({"v": {"method": "locf"}}, partition_by_fields=["user_id"], sort_by={"event_id": 1}).project(lambda f: {"event_id": 1, "x": f.v}).df


@query(f"select event_id, round(coalesce(v, x0 + (x1 - x0) * (event_id - k0) / (k1 - k0)) + 0.000013, 4) x from {_LINEAR}")
def fill_linear(s, d):
    return _gaps(s, d).fill({"v": {"method": "linear"}}, partition_by_fields=["user_id"], sort_by={"event_id": 1}).project(lambda f: {"event_id": 1, "x": _n(f.v, 4)}).df


@query("select c_custkey, count(o_orderkey) n, coalesce(round(sum(o_totalprice), 2), 0) total from customer left join orders on o_custkey = c_custkey group by 1")
def lookup_equi(s, d):
    p = _t(s, d, "customer").lookup("orders", s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice"), "c_custkey", "o_custkey")
    return p.project(lambda f: {"c_custkey": 1, "n": fn.size(f.orders).cast("bigint"), "total": _r(fn.sum(f["orders.o_totalprice"]).expr(), 2)}).df


@query("select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey")
def lookup_unwind(s, d):
    p = _t(s, d, "customer").lookup_unwind(s.read.parquet(f"{d}/orders.parquet"), "c_custkey", "o_custkey", "o", True)
    return p.project(lambda f: {"c_custkey": 1, "o_orderkey": f["o.o_orderkey"]}).df


@query("select c_custkey, count(o_orderkey) n from customer left join orders on o_custkey = c_custkey and o_totalprice > c_acctbal * 30 group by 1")
def lookup_correlated(s, d):
    sub = lambda p, outer: p.match(lambda f: (f.o_custkey == outer.k) & (f.o_totalprice > outer.bal * 30)).project({"o_orderkey": 1})
    p = _t(s, d, "customer").lookup("o", s.read.parquet(f"{d}/orders.parquet"), let=lambda f: {"k": f.c_custkey, "bal": f.c_acctbal}, pipeline=sub)
    return p.project(lambda f: {"c_custkey": 1, "n": fn.size(f.o).cast("bigint")}).df


@query("select c_custkey, count(o_orderkey) filter (o_orderstatus = 'F') n from customer left join orders on o_custkey = c_custkey group by 1")
def lookup_concise(s, d):
    p = _t(s, d, "customer").lookup("o", s.read.parquet(f"{d}/orders.parquet"), "c_custkey", "o_custkey", pipeline=lambda p: p.match({"o_orderstatus": "F"}))
    return p.project(lambda f: {"c_custkey": 1, "n": fn.size(f.o).cast("bigint")}).df


@query("select r_regionkey, 'a,b' names from region")
def lookup_documents(s, d):
    p = _t(s, d, "region").lookup("x", [{"name": "a"}, {"name": "b"}], pipeline=lambda p: p.sort({"name": 1}))
    return p.project(lambda f: {"r_regionkey": 1, "names": F.array_join(f["x.name"], ",")}).df


@query("select c_custkey, string_agg(o_orderkey::varchar, ',' order by n) ids from customer left join (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) n from orders) on o_custkey = c_custkey and n <= 2 group by 1")
def lookup_top_k(s, d):
    sub = lambda p, outer: p.match(lambda f: f.o_custkey == outer.k).sort({"o_totalprice": -1, "o_orderkey": 1}).limit(2)
    p = _t(s, d, "customer").lookup("o", s.read.parquet(f"{d}/orders.parquet"), let=lambda f: {"k": f.c_custkey}, pipeline=sub)
    return p.project(lambda f: {"c_custkey": 1, "ids": F.nullif(F.array_join(f["o.o_orderkey"].cast("array<string>"), ","), F.lit(""))}).df


@query("""with recursive g as (select c_custkey k, c_custkey // 3 up, 0 depth from customer union all select k, up // 3, depth + 1 from g join customer on c_custkey = up where up > 0)
 select k, count(*) n, max(depth)::bigint deepest from g where up > 0 and up in (select c_custkey from customer) group by 1""")
def graph_lookup(s, d):
    edges = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("_id"), F.floor(F.col("c_custkey") / 3).cast("bigint").alias("boss"))
    p = Pipeline(edges).graph_lookup(edges.where("_id > 0"), lambda f: f.boss, "boss", "_id", "up", depth_field="depth")
    p = p.match(lambda f: fn.gt(fn.size(f.up), 0))
    return p.project(lambda f: {"_id": 0, "k": f["_id"], "n": fn.size(f.up).cast("bigint"), "deepest": F.array_max(f["up.depth"])}).df


@query("select r_regionkey k, r_name name, -1 up from region union all select n_nationkey, n_name, n_regionkey from nation")
def union_with(s, d):
    p = _t(s, d, "region").project(lambda f: {"k": f.r_regionkey, "name": f.r_name})
    return p.union_with(_t(s, d, "nation").project(lambda f: {"k": f.n_nationkey, "name": f.n_name, "up": f.n_regionkey})).fill({"up": {"value": -1}}).df


@query("select (select string_agg(o_orderkey::varchar, ',' order by o_totalprice desc, o_orderkey) from (from orders order by o_totalprice desc, o_orderkey limit 3)) top, (select count(*) from orders where o_orderstatus = 'F') f, (select count(distinct o_orderpriority) from orders) pr")
def facet(s, d):
    p = _t(s, d, "orders").facet({"top": lambda p: p.sort({"o_totalprice": -1, "o_orderkey": 1}).limit(3).project({"o_orderkey": 1, "o_totalprice": 1}), "f": lambda p: p.match({"o_orderstatus": "F"}).count("n"), "pr": lambda p: p.sort_by_count(lambda f: f.o_orderpriority)})
    return p.project(lambda f: {"top": F.array_join(f["top.o_orderkey"].cast("array<string>"), ","), "f": f.f[0]["n"], "pr": fn.size(f.pr).cast("bigint")}).df


@query("""select l_orderkey, l_linenumber, l_partkey, round(abs(l_discount - 0.05), 4) a, ceil(l_tax * 10) b, floor(l_quantity / 7) c, round(sqrt(l_quantity), 6) e, round(exp(l_tax), 6) g, round(ln(l_quantity), 6) h, round(log10(l_quantity), 6) i, round_even(l_extendedprice, -2) j,
 trunc(l_tax * 100) / 100 k, l_partkey % 7 m, round(pow(l_tax + 1, 2), 6) n, round(log(2, l_quantity), 6) o, round(l_quantity / 3, 6) p, round(1 / (1 + exp(-l_tax)), 6) q from lineitem""")
def arith_all(s, d):
    p = _t(s, d, "lineitem").project(lambda f: {"l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1, "a": _r(fn.abs(fn.subtract(f.l_discount, 0.05))), "b": fn.ceil(fn.multiply(f.l_tax, 10)), "c": fn.floor(fn.divide(f.l_quantity, 7)), "e": _r(fn.sqrt(f.l_quantity), 6), "g": _r(fn.exp(f.l_tax), 6), "h": _r(fn.ln(f.l_quantity), 6), "i": _r(fn.log10(f.l_quantity), 6), "j": fn.round(f.l_extendedprice, -2), "k": fn.trunc(f.l_tax, 2), "m": fn.mod(f.l_partkey, 7), "n": _r(fn.pow(fn.add(f.l_tax, 1), 2), 6), "o": _r(fn.log(f.l_quantity, 2), 6), "p": _r(fn.divide(f.l_quantity, 3), 6), "q": _r(fn.sigmoid(f.l_tax), 6)})
    return p.df


@query("""select l_orderkey, l_linenumber, l_partkey, round(sin(l_tax) + cos(l_tax) + tan(l_tax), 6) a, round(asin(l_tax) + acos(l_tax) + atan(l_tax) + atan2(l_tax, 2), 6) b, round(sinh(l_tax) + cosh(l_tax) + tanh(l_tax), 6) c,
 round(asinh(l_tax) + acosh(l_quantity) + atanh(l_tax), 6) e, round(radians(l_quantity) + degrees(l_tax), 6) g from lineitem""")
def trig_all(s, d):
    add = fn.add
    p = _t(s, d, "lineitem").project(lambda f: {"l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1, "a": _r(add(fn.sin(f.l_tax), fn.cos(f.l_tax), fn.tan(f.l_tax)), 6), "b": _r(add(fn.asin(f.l_tax), fn.acos(f.l_tax), fn.atan(f.l_tax), fn.atan2(f.l_tax, 2)), 6), "c": _r(add(fn.sinh(f.l_tax), fn.cosh(f.l_tax), fn.tanh(f.l_tax)), 6), "e": _r(add(fn.asinh(f.l_tax), fn.acosh(f.l_quantity), fn.atanh(f.l_tax)), 6), "g": _r(add(fn.degrees_to_radians(f.l_quantity), fn.radians_to_degrees(f.l_tax)), 6)})
    return p.df


@query("""select p_partkey, upper(p_name) a, lower(p_name) b, length(p_name)::int c, strlen(p_name)::int e, p_name || '-' || p_brand g, string_split(p_name, ' ')[1] h, substr(p_name, 3, 4) i, instr(p_name, 'e')::int - 1 j, trim('#' || p_name || '##', '#') k,
 replace(p_name, 'a', 'A') m, case when instr(p_name, 'a') > 0 then substr(p_name, 1, instr(p_name, 'a') - 1) || 'X' || substr(p_name, instr(p_name, 'a') + 1) else p_name end n, case when lower(p_name) < lower(p_brand) then -1 when lower(p_name) > lower(p_brand) then 1 else 0 end o, ltrim('  ' || p_name) q from part""")
def str_all(s, d):
    p = _t(s, d, "part").project(lambda f: {"p_partkey": 1, "a": fn.to_upper(f.p_name), "b": fn.to_lower(f.p_name), "c": fn.str_len_cp(f.p_name), "e": fn.str_len_bytes(f.p_name), "g": fn.concat(f.p_name, "-", f.p_brand), "h": fn.array_elem_at(fn.split(f.p_name, " "), 0), "i": fn.substr_cp(f.p_name, 2, 4), "j": fn.index_of_cp(f.p_name, "e"), "k": fn.trim(fn.concat("#", f.p_name, "##"), "#"), "m": fn.replace_all(f.p_name, "a", "A"), "n": fn.replace_one(f.p_name, "a", "X"), "o": fn.strcasecmp(f.p_name, f.p_brand), "q": fn.ltrim(fn.concat("  ", f.p_name))})
    return p.df


@query("select doc_id, substr(text, 4, 6) a, instr(substr(text, 1, 40), 'é')::int - 1 b, case when instr(substr(text, 1, 40), 'é') = 0 then -1 else strlen(substr(text, 1, instr(substr(text, 1, 40), 'é') - 1)) end::int c from documents")
def str_substr_index(s, d):
    p = _t(s, d, "documents").add_fields(lambda f: {"t": fn.substr_cp(f.text, 0, 40)})
    return p.project(lambda f: {"doc_id": 1, "a": fn.substr_cp(f.text, 3, 6), "b": fn.index_of_cp(f.t, "é"), "c": fn.index_of_bytes(f.t, "é")}).df


@query("select p_partkey, regexp_extract(p_name, '([a-z]+)([0-9]*)') m, regexp_extract(p_name, '([a-z]+)([0-9]*)', 1) g1, regexp_matches(p_name, '[0-9]') has, len(regexp_extract_all(p_name, '[a-z]+'))::int n from part where regexp_matches(p_name, '([a-z]+)([0-9]*)')")
def regex_find(s, d):
    p = _t(s, d, "part").add_fields(lambda f: {"x": fn.regex_find(f.p_name, "([a-z]+)([0-9]*)"), "y": fn.regex_find_all(f.p_name, "[a-z]+")}).match({"x": {"$ne": None}})
    return p.project(lambda f: {"p_partkey": 1, "m": f["x.match"], "g1": f["x.captures"][0], "has": fn.regex_match(f.p_name, "[0-9]"), "n": fn.size(f.y)}).df


@query(f"select event_id, coalesce(v > 10, false) and true a, coalesce(v > 10, false) or v is null b, not coalesce(v > 10, false) c, case when v is null then -1 when v < 10 then -1 when v > 10 then 1 else 0 end e, v is not distinct from 10 g, coalesce(v < 5, true) h from {_NULLS}")
def logic_all(s, d):
    p = _t(s, d, "events").project(lambda f: {"event_id": 1, "v": F.when(f.event_id % 7 != 0, f.value)})
    return p.project(lambda f: {"event_id": 1, "a": fn.and_(f.v > 10, True), "b": fn.or_(f.v > 10, fn.eq(f.v, None)), "c": fn.not_(f.v > 10), "e": fn.cmp(f.v, 10), "g": fn.eq(f.v, 10), "h": fn.lt(f.v, 5)}).df


@query("select p_partkey, case when p_size < 10 then 's' when p_size < 30 then 'm' else 'l' end a, p_size in (1, 2, 3) b, case when p_size % 2 = 0 then 'even' else 'odd' end c, coalesce(nullif(p_brand, 'Brand#11'), 'none') e from part")
def switch_cond_ifnull(s, d):
    p = _t(s, d, "part").project(lambda f: {"p_partkey": 1, "a": fn.switch([(fn.lt(f.p_size, 10), "s"), (fn.lt(f.p_size, 30), "m")], "l"), "b": fn.is_in(f.p_size, [1, 2, 3]), "c": fn.cond(fn.eq(fn.mod(f.p_size, 2), 0), "even", "odd"), "e": fn.if_null(F.nullif(f.p_brand, F.lit("Brand#11")), "none")})
    return p.df


_QTYS = "(select l_orderkey _id, list(l_quantity order by l_quantity, l_linenumber) q, list(l_linenumber order by l_linenumber) n from lineitem group by 1)"


def _qtys(s, d):
    g = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("_id"))
    return Pipeline(g.agg(F.array_sort(F.collect_list("l_quantity")).alias("q"), F.array_sort(F.collect_list("l_linenumber")).alias("n")))


@query(f"""select _id, len(q)::int a, list_reverse(q)[1] b, array_to_string(list_concat(n, [9]), ',') c, coalesce(list_position(n, 2), 0)::int - 1 e, array_to_string(range(2, 9, 3), ',') g, array_to_string(n[1:2], ',') h, q[-1] i, list_sum(q) j, list_min(q) k, list_max(q) m, round(list_avg(q), 4) o,
 len(list_filter(q, lambda x: x > 25))::int p, list_sum(list_transform(q, lambda x: x * 2)) r, array_to_string(list_sort(n, 'DESC'), ',') t, len(list_filter(n, lambda x: x <= 0)) = 0 u, array_to_string(n[-2:], ',') w from {_QTYS}""")
def array_all(s, d):
    j = lambda x: F.array_join(x.cast("array<string>"), ",")
    p = _qtys(s, d).project(lambda f: {"_id": 1, "a": fn.size(f.q), "b": fn.array_elem_at(fn.reverse_array(f.q), 0), "c": j(fn.concat_arrays(f.n, [9])), "e": fn.index_of_array(f.n, 2), "g": j(fn.range(2, 9, 3)), "h": j(fn.slice(f.n, 2)), "i": fn.array_elem_at(f.q, -1), "j": fn.sum(f.q), "k": fn.min(f.q), "m": fn.max(f.q), "o": _r(fn.avg(f.q).expr()), "p": fn.size(fn.filter(f.q, lambda x: x > 25)), "r": fn.reduce(fn.map(f.q, lambda x: fn.multiply(x, 2)), 0.0, lambda a, x: fn.add(a, x)), "t": j(fn.sort_array(f.n, -1)), "u": fn.all_elements_true(fn.map(f.n, lambda x: x > 0)), "w": j(fn.slice(f.n, -2))})
    return p.df


@query(f"select _id, len(list_distinct(list_concat(n, [1, 9])))::int a, len(list_intersect(n, [1, 2, 3]))::int b, len(list_filter(list_distinct(n), lambda x: x not in (1, 2)))::int c, list_has_all([1, 2, 3, 4], n) e, list_sort(list_distinct(n)) = [1, 2] g from {_QTYS}")
def array_sets(s, d):
    p = _qtys(s, d).project(lambda f: {"_id": 1, "a": fn.size(fn.set_union(f.n, [1, 9])), "b": fn.size(fn.set_intersection(f.n, [1, 2, 3])), "c": fn.size(fn.set_difference(f.n, [1, 2])), "e": fn.set_is_subset(f.n, [1, 2, 3, 4]), "g": fn.set_equals(f.n, [1, 2])})
    return p.df


@query(f"select _id, array_to_string(list_transform(range(1, least(len(n), 3) + 1), lambda i: n[i]::varchar || ':' || q[i]::int::varchar), ',') z from {_QTYS}")
def zip_arrays(s, d):
    p = _qtys(s, d).add_fields(lambda f: {"z": fn.zip([f.n.cast("array<int>"), f.q.cast("array<int>"), F.array(F.lit(0), F.lit(0), F.lit(0))])})
    return p.project(lambda f: {"_id": 1, "z": F.array_join(fn.map(f.z, lambda x: F.concat_ws(":", x[0].cast("string"), x[1].cast("string"))), ",")}).df


@query("select c_custkey, c_name name, c_nationkey + 1 nation, c_mktsegment seg, 'nation,name' ks from customer")
def object_ops(s, d):
    p = _t(s, d, "customer").add_fields(lambda f: {"o": fn.merge_objects(F.struct(f.c_nationkey.alias("nation"), F.lit("x").alias("name")), F.struct(f.c_name.alias("name")))})
    p = p.add_fields(lambda f: {"o": fn.set_field("seg", fn.set_field("nation", f.o, fn.add(fn.get_field("nation", f.o), 1)), f.c_mktsegment)})
    ks = lambda f: F.array_join(fn.map(fn.object_to_array(F.struct(f["o.nation"].cast("string").alias("nation"), f["o.name"].alias("name"))), lambda x: x["k"]), ",")
    return p.project(lambda f: {"c_custkey": 1, "name": f["o.name"], "nation": f["o.nation"], "seg": f["o.seg"], "ks": ks(f)}).df


@query("select event_id, year(ts)::int a, month(ts)::int b, day(ts)::int c, hour(ts)::int e, minute(ts)::int g, second(ts)::int h, (dayofweek(ts) + 1)::int i, dayofyear(ts)::int j, weekofyear(ts)::int k, isoyear(ts) m, isodow(ts)::int n, floor((dayofyear(ts) + 6 - dayofweek(ts)) / 7)::int o from events")
def date_parts(s, d):
    names = {"a": fn.year, "b": fn.month, "c": fn.day_of_month, "e": fn.hour, "g": fn.minute, "h": fn.second, "i": fn.day_of_week, "j": fn.day_of_year, "k": fn.iso_week, "m": fn.iso_week_year, "n": fn.iso_day_of_week, "o": fn.week}
    return _t(s, d, "events").project(lambda f: {"event_id": 1} | {k: g(f.ts) for k, g in names.items()}).df


@query("select event_id, ts + interval 3 month a, ts - interval 36 hour b, ts + interval 1500 millisecond c, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000 e from events")
def date_arith(s, d):
    p = _t(s, d, "events").project(lambda f: {"event_id": 1, "a": fn.date_add(f.ts, "month", 3), "b": fn.date_subtract(f.ts, "hour", 36), "c": fn.add(f.ts, 1500), "e": fn.subtract(f.ts, fn.literal(datetime(2024, 1, 1)))})
    return p.df


@query("select o_orderkey, date_diff('month', o_orderdate, timestamp '1998-12-01') a, date_diff('day', o_orderdate, timestamp '1998-12-01') b, date_diff('year', o_orderdate, timestamp '1998-12-01') c, date_diff('hour', o_orderdate, timestamp '1998-12-01') e, date_diff('quarter', o_orderdate, timestamp '1998-12-01') g from orders")
def date_diff(s, d):
    end = datetime(1998, 12, 1)
    units = {"a": "month", "b": "day", "c": "year", "e": "hour", "g": "quarter"}
    return _t(s, d, "orders").project(lambda f: {"o_orderkey": 1} | {k: fn.date_diff(f.o_orderdate, fn.literal(end), u) for k, u in units.items()}).df


@query("select event_id, date_trunc('month', ts) a, time_bucket(interval 6 hour, ts, timestamp '2000-01-01') b, date_trunc('week', ts) c, time_bucket(interval 2 day, ts, timestamp '2000-01-01') e from events")
def date_trunc_bin(s, d):
    p = _t(s, d, "events").project(lambda f: {"event_id": 1, "a": fn.date_trunc(f.ts, "month"), "b": fn.date_trunc(f.ts, "hour", 6), "c": fn.date_trunc(f.ts, "week", start_of_week="monday").cast("date").cast("timestamp_ntz"), "e": fn.date_trunc(f.ts, "day", 2)})
    return p.df


@query("select event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') a, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' b, date_trunc('second', ts) c, make_timestamp(year(ts), month(ts), day(ts), 0, 0, 0.0) e from events")
def date_format_parse(s, d):
    p = _t(s, d, "events").project(lambda f: {"event_id": 1, "a": fn.date_to_string(f.ts, "%Y/%m/%d %H:%M:%S"), "b": fn.date_to_string(f.ts), "c": fn.date_from_string(fn.date_to_string(f.ts, "%Y/%m/%d %H:%M:%S"), "%Y/%m/%d %H:%M:%S"), "e": fn.date_from_parts(fn.year(f.ts), fn.month(f.ts), fn.day_of_month(f.ts))})
    return p.df


@query("select event_id, event_id::varchar a, trunc(value)::int b, value <> 0 c, true e, value::int::varchar g, coalesce(try_cast(event_type as int), -1) h, 'string' i, 'long' j, true k from events")
def convert_ops(s, d):
    p = _t(s, d, "events").project(lambda f: {"event_id": 1, "a": fn.to_string(f.event_id), "b": fn.to_int(f.value), "c": fn.to_bool(f.value), "e": fn.to_bool(f.event_type), "g": fn.to_string(fn.to_int(F.bround(f.value, 0))), "h": fn.convert(f.event_type, "int", on_error=-1), "i": fn.type_of(f.event_type), "j": fn.type_of(f.event_id), "k": fn.is_number(f.value)})
    return p.df


@query("select p_partkey, upper(md5(p_name)) a, upper(sha256(p_name)) b, strlen(p_name)::int c, to_base64(p_name::blob) e, upper(hex(p_name::blob)) g from part")
def hash_ops(s, d):
    p = _t(s, d, "part").project(lambda f: {"p_partkey": 1, "a": fn.hex_hash(f.p_name, "md5"), "b": fn.hex_hash(f.p_name, "sha256"), "c": fn.binary_size(f.p_name), "e": fn.convert(fn.convert(f.p_name, "binData", "utf8"), "string", "base64"), "g": fn.convert(fn.convert(f.p_name, "binData", "utf8"), "string", "hex")})
    return p.df


@query("select p_partkey, p_size & 12 a, p_size | 3 b, xor(p_size, 5) c, ~p_size e from part")
def bit_ops(s, d):
    return _t(s, d, "part").project(lambda f: {"p_partkey": 1, "a": fn.bit_and(f.p_size, 12), "b": fn.bit_or(f.p_size, 3), "c": fn.bit_xor(f.p_size, 5), "e": fn.bit_not(f.p_size)}).df


@query("select event_id, (props::json->>'k')::int k from events")
def json_props(s, d):
    return _t(s, d, "events").project(lambda f: {"event_id": 1, "k": fn.get_field("k", fn.to_object(f.props, "k int"))}).df


_QV = [round(((i * 37) % 19 - 9) / 10, 2) for i in range(64)]


@query(f"select vec_id, round(list_cosine_similarity(embedding::double[], {_QV}::double[]), 5) a, round(list_inner_product(embedding::double[], {_QV}::double[]), 5) b, round(list_distance(embedding::double[], {_QV}::double[]), 5) c from embeddings")
def similarity(s, d):
    p = _t(s, d, "embeddings").project(lambda f: {"vec_id": 1, "a": _r(fn.similarity_cosine(f.embedding, _QV), 5), "b": _r(fn.similarity_dot_product(f.embedding, _QV), 5), "c": _r(fn.similarity_euclidean(f.embedding, _QV), 5)})
    return p.df


@query(f"select vec_id, round((1 + list_cosine_similarity(embedding::double[], {_QV}::double[])) / 2, 5) score from embeddings where label < 5 order by list_cosine_similarity(embedding::double[], {_QV}::double[]) desc, vec_id limit 10")
def vector_search(s, d):
    p = _t(s, d, "embeddings").vector_search("embedding", _QV, 10, filter={"label": {"$lt": 5}}, id_col="vec_id")
    return p.project(lambda f: {"vec_id": 1, "score": _r(fn.meta("vectorSearchScore"), 5)}).df


@query("""with a as (from (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) r from orders) where r <= 20), b as (from (select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) r from orders) where r <= 20)
 select o_orderkey, round(sum(w), 6) score from (select o_orderkey, 2 / (60 + r) w from a union all select o_orderkey, 1 / (60 + r) from b) group by 1""")
def rank_fusion(s, d):
    branch = lambda k: lambda p: p.sort({k: -1, "o_orderkey": 1}).limit(20).project({"o_orderkey": 1, "o_totalprice": 1, "o_orderdate": 1})
    p = _t(s, d, "orders").rank_fusion({"a": branch("o_totalprice"), "b": branch("o_orderdate")}, "o_orderkey", {"a": 2.0})
    return p.project(lambda f: {"o_orderkey": 1, "score": _r(fn.meta("score"), 6)}).df


@query("""with a as (select p_partkey, p_size from part order by p_retailprice desc, p_partkey limit 30), m as (select *, coalesce((p_size - min(p_size) over ()) / nullif((max(p_size) over () - min(p_size) over ())::double, 0), 0) x from a)
 select p_partkey, round((x + x * 3) / 2, 6) score from m""")
def score_fusion(s, d):
    branch = lambda p: p.sort({"p_retailprice": -1, "p_partkey": 1}).limit(30).score(lambda f: f.p_size)
    p = _t(s, d, "part").score_fusion({"a": branch, "b": branch}, "p_partkey", "minMaxScaler", {"b": 3.0})
    return p.project(lambda f: {"p_partkey": 1, "score": _r(fn.meta("score"), 6)}).df


@query("select doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x in ('the', 'le')))::double score from documents where list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['the', 'le'])")
def text_search(s, d):
    p = _t(s, d, "documents").search({"text": {"query": "the le", "path": "text"}})
    return p.project(lambda f: {"doc_id": 1, "score": fn.meta("searchScore")}).df


@query("""with g as (select c_custkey, (c_custkey % 360) - 180.0 lon, (c_custkey % 170) - 85.0 lat from customer), h as (select *, 2 * 6378100 * asin(sqrt(least(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lon - 20) / 2), 2), 1))) m from g)
 select c_custkey, round(m, 1) dist from h where m <= 3000000""")
def geo_near(s, d):
    g = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.struct(F.lit("Point").alias("type"), F.array((F.col("c_custkey") % 360 - 180.0).cast("double"), (F.col("c_custkey") % 170 - 85.0).cast("double")).alias("coordinates")).alias("at"))
    p = Pipeline(g).geo_near({"type": "Point", "coordinates": [20.0, 10.0]}, "dist", "at", max_distance=3_000_000)
    return p.project(lambda f: {"c_custkey": 1, "dist": _r(f.dist, 1)}).df


@query("select c_custkey from customer where (c_custkey % 100) between 10 and 30 and (c_custkey % 77) between 5 and 40")
def geo_within(s, d):
    p = _t(s, d, "customer").add_fields(lambda f: {"at": F.array((f.c_custkey % 100).cast("double"), (f.c_custkey % 77).cast("double"))})
    return p.match({"at": {"$geoWithin": {"$box": [[10, 5], [30, 40]]}}}).project({"c_custkey": 1}).df


@query("select distinct c_mktsegment as value from customer where c_acctbal > 0")
def distinct(s, d):
    return Collection(s.read.parquet(f"{d}/customer.parquet"), "c_custkey").find({"c_acctbal": {"$gt": 0}}).distinct("c_mktsegment")


@query("select o_orderkey, c_name name from orders left join customer on c_custkey = o_custkey")
def populate_single(s, d):
    out = populate(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey"), "o_custkey", s.read.parquet(f"{d}/customer.parquet"), "c_custkey", ["c_name"])
    return out.select("o_orderkey", F.col("o_custkey.c_name").alias("name"))


@query("select l_orderkey k, string_agg(p_brand, ',' order by l_linenumber, l_partkey) brands from lineitem join part on p_partkey = l_partkey group by 1")
def populate_array(s, d):
    own = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts"))
    out = populate(own, "parts", s.read.parquet(f"{d}/part.parquet"), "p_partkey", ["p_brand"])
    return out.select("k", F.array_join("parts.p_brand", ",").alias("brands")).where("brands <> ''")


@query("select c_custkey, count(o_orderkey) n from customer left join orders on o_custkey = c_custkey group by 1")
def populate_reverse_count(s, d):
    out = populate_virtual(s.read.parquet(f"{d}/customer.parquet"), "n", s.read.parquet(f"{d}/orders.parquet"), "c_custkey", "o_custkey", count=True)
    return out.select("c_custkey", "n")


@query(f"select c_custkey, string_agg(o_orderkey::varchar, ',' order by n) ids from customer left join {_RANKED} on k = c_custkey and n <= 3 group by 1")
def populate_reverse_limit(s, d):
    out = populate_virtual(s.read.parquet(f"{d}/customer.parquet"), "o", s.read.parquet(f"{d}/orders.parquet"), "c_custkey", "o_custkey", sort={"o_totalprice": -1, "o_orderkey": 1}, per_document_limit=3)
    return out.select("c_custkey", F.nullif(F.array_join(F.col("o.o_orderkey").cast("array<string>"), ","), F.lit("")).alias("ids"))


@query("select c_custkey, case when h then 'X' else c_name end c_name, case when h then c_nationkey + 5 else c_nationkey end c_nationkey, round(case when h then c_acctbal * 2 else c_acctbal end, 2) c_acctbal, case when h then null else c_mktsegment end c_mktsegment from (select *, c_acctbal > 5000 h from customer)")
def update_ops(s, d):
    out = Writer(s.read.parquet(f"{d}/customer.parquet"), "c_custkey").update_many({"c_acctbal": {"$gt": 5000}}, {"$set": {"c_name": "X"}, "$inc": {"c_nationkey": 5}, "$mul": {"c_acctbal": 2}, "$unset": {"c_mktsegment": 1}})
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(f"select _id, array_to_string(list_concat([0], list_filter(n, lambda x: x <> 2), case when list_contains(n, 7) then [] else [7] end), ',') n, array_to_string(list_transform(q, lambda x: case when x > 40 then 0 else x end), ',') q from {_QTYS}")
def update_arrays(s, d):
    w = Writer(_qtys(s, d).df)
    out = w.update_many(lambda f: fn.literal(True), {"$pull": {"n": 2}})
    out = Writer(out).update_many(lambda f: fn.literal(True), {"$push": {"n": {"$each": [0], "$position": 0}}, "$set": {"q.$[big]": 0.0}}, [{"big": {"$gt": 40}}])
    out = Writer(out).update_many(lambda f: fn.literal(True), {"$addToSet": {"n": {"$each": [7, 0]}}})
    return out.select("_id", F.array_join(F.col("n").cast("array<string>"), ",").alias("n"), F.array_join(F.col("q").cast("array<string>"), ",").alias("q"))


@query("select coalesce(a.k, b.k) k, case when a.k is not null and b.k is not null then a.v + b.v else coalesce(a.v, b.v) end v from (select n_regionkey k, sum(n_nationkey)::bigint v from nation where n_regionkey < 3 group by 1) a full join (select r_regionkey k, 1000::bigint v from region where r_regionkey > 0) b on a.k = b.k")
def merge_upsert(s, d):
    old = _t(s, d, "nation").match({"n_regionkey": {"$lt": 3}}).group(lambda f: {"_id": f.n_regionkey, "v": fn.sum(f.n_nationkey)}).df.select(F.col("_id").alias("k"), F.col("v").cast("bigint"))
    new = s.read.parquet(f"{d}/region.parquet").where("r_regionkey > 0").select(F.col("r_regionkey").alias("k"), F.lit(1000).cast("bigint").alias("v"))
    return merged(old, new, ["k"], lambda o, n: {"v": fn.add(o.v, n.v)})


@query("select o_orderkey, o_custkey from orders where o_orderkey % 3 <> 0 and o_orderstatus = 'O'")
def policy_scope(s, d):
    df = s.read.parquet(f"{d}/orders.parquet").withColumn("deleted_at", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")))
    c = Collection(df, "o_orderkey", Policies(hidden=("o_totalprice", "o_orderdate", "o_orderpriority"), deleted_at="deleted_at", tenant=("o_orderstatus", "O")))
    return c.find().df().drop("deleted_at", "o_orderstatus")


@query("select l_returnflag region, count(*) n, round(sum(l_extendedprice), 2) total, round(avg(l_quantity), 4) mean, max(l_extendedprice) best from lineitem where l_quantity >= 5 group by 1")
def j_group(s, d):
    p = _t(s, d, "lineitem").match({"l_quantity": {"$gte": 5}}).group(lambda f: {"_id": f.l_returnflag, "n": fn.count(), "total": fn.sum(f.l_extendedprice), "mean": fn.avg(f.l_quantity), "best": fn.max(f.l_extendedprice)})
    return p.project(lambda f: {"_id": 0, "region": f["_id"], "n": 1, "total": _r(f.total, 2), "mean": _r(f.mean), "best": 1}).df


@query("select p_brand brand, count(*) n, round(sum(l_extendedprice), 2) total from lineitem join part on p_partkey = l_partkey group by 1")
def j_lookup(s, d):
    p = _t(s, d, "lineitem").project({"l_partkey": 1, "l_extendedprice": 1}).lookup_unwind(s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand"), "l_partkey", "p_partkey", "part")
    p = p.group(lambda f: {"_id": f["part.p_brand"], "n": fn.count(), "total": fn.sum(f.l_extendedprice)})
    return p.project(lambda f: {"_id": 0, "brand": f["_id"], "n": 1, "total": _r(f.total, 2)}).df


@query("select (select count(distinct l_returnflag) from lineitem) a, (select count(*) from lineitem where l_quantity > 25) b, (select count(*) from (select 1 from lineitem group by case when l_quantity < 10 then 0 when l_quantity < 30 then 10 else 30 end)) c")
def j_facet(s, d):
    p = _t(s, d, "lineitem").project({"l_returnflag": 1, "l_quantity": 1}).facet({"a": lambda p: p.sort_by_count(lambda f: f.l_returnflag), "b": lambda p: p.match({"l_quantity": {"$gt": 25}}).count("n"), "c": lambda p: p.bucket(lambda f: f.l_quantity, [0, 10, 30, 1000])})
    return p.project(lambda f: {"a": fn.size(f.a).cast("bigint"), "b": f.b[0]["n"], "c": fn.size(f.c).cast("bigint")}).df


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() over (partition by l_suppkey order by l_extendedprice desc) r, round(sum(l_extendedprice) over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey rows between 6 preceding and current row), 2) x from lineitem")
def j_window(s, d):
    p = _t(s, d, "lineitem").set_window_fields({"r": fn.rank()}, lambda f: f.l_suppkey, {"l_extendedprice": -1})
    p = p.set_window_fields(lambda f: {"x": fn.with_window(fn.sum(f.l_extendedprice), documents=[-6, "current"])}, lambda f: f.l_suppkey, {"l_shipdate": 1, "l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1})
    return p.project(lambda f: {"l_orderkey": 1, "l_linenumber": 1, "l_partkey": 1, "l_suppkey": 1, "r": f.r.cast("bigint"), "x": _r(f.x, 2)}).df


@query("""with a as (select p_brand, year(l_shipdate)::int y, round(sum(l_extendedprice * (1 - l_discount)), 2) rev, count(*) n from lineitem join part on p_partkey = l_partkey where l_quantity > 3 and l_returnflag <> 'X' group by all having count(*) >= 2)
 select p_brand brand, y, rev, n, dense_rank() over (partition by y order by rev desc) r from a qualify r <= 5""")
def j_pipeline15(s, d):
    p = _t(s, d, "lineitem").match({"l_quantity": {"$gt": 3}}).match({"l_returnflag": {"$ne": "X"}})
    p = p.project({"l_partkey": 1, "l_extendedprice": 1, "l_discount": 1, "l_shipdate": 1})
    p = p.add_fields(lambda f: {"rev": fn.multiply(f.l_extendedprice, fn.subtract(1, f.l_discount))}).set(lambda f: {"y": fn.year(f.l_shipdate)}).unset("l_shipdate")
    p = p.lookup_unwind(s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand"), "l_partkey", "p_partkey", "part")
    p = p.group(lambda f: {"_id": {"brand": f["part.p_brand"], "y": f.y}, "rev": fn.sum(f.rev), "n": fn.count()}).match({"n": {"$gte": 2}})
    p = p.add_fields(lambda f: {"rev": _r(f.rev, 2)}).set_window_fields({"r": fn.dense_rank()}, lambda f: f["_id.y"], {"rev": -1}).match({"r": {"$lte": 5}})
    p = p.project(lambda f: {"_id": 0, "brand": f["_id.brand"], "y": f["_id.y"], "rev": 1, "n": 1, "r": f.r.cast("bigint")})
    return p.sort({"y": 1, "r": 1, "brand": 1}).df


@query("select o_orderkey as _id, 'o_orderstatus' updated from orders where o_orderkey % 5 = 0 and o_orderstatus <> 'X'")
def stream_watch(s, d):
    """Events of a change log, read as a stream to its end."""
    docs = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("_id"), "o_orderstatus", "o_totalprice")
    now = F.struct(*docs.columns)
    inserts = docs.select(F.lit("insert").alias("op"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("_id").alias("key"), F.lit(None).cast(docs.select(now.alias("x")).schema[0].dataType).alias("before"), now.alias("after"))
    path = scratch_path(s, "change-log")
    changed = docs.where("_id % 5 = 0").select(F.lit("update").alias("op"), F.lit("2024-01-02").cast("timestamp").alias("ts"), F.col("_id").alias("key"), now.alias("before"), F.struct(F.col("_id"), F.lit("X").alias("o_orderstatus"), F.col("o_totalprice")).alias("after"))
    inserts.unionByName(changed).write.mode("overwrite").parquet(f"{path}/log")
    events = watch(s, f"{path}/log", docs.schema, build=lambda p: p.match({"operationType": "update"}).project(lambda f: {"documentKey": 1, "updateDescription": 1}))
    run = events.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/events")
    run.awaitTermination()
    assert log_schema(docs.schema)["op"].dataType.simpleString() == "string"
    return s.read.parquet(f"{path}/events").select(F.col("documentKey._id").alias("_id"), F.array_join("updateDescription.updatedFields", ",").alias("updated"))
