"""Stages, filters, updates and sinks on small rows with known results."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import fn
from docloom.functions.core import REMOVE
from docloom.operators.filters import FilterError, compile_filter
from docloom.operators.pipeline import Pipeline, PipelineError
from docloom.operators.query import Collection, Policies, populate, populate_by, populate_virtual
from docloom.operators.series import granular
from docloom.operators.update import UpdateError, Writer
from docloom.sources.collections import Materialized, View, merged, replace_collection
from docloom.streaming.change_log import apply_changes, log_schema

ORDERS = [
    ("1", "paid", "ann", [("a", 10.0, 2.0, ["x", "y"]), ("b", 5.0, None, None)], 25.0, 0.1, datetime(2024, 1, 10, 10)),
    ("2", "open", "ann", [("c", 30.0, 1.0, None)], 30.0, None, datetime(2024, 2, 11, 12, 30)),
    ("3", "paid", "bob", [], 12.0, None, datetime(2024, 3, 12, 8, 15)),
]
SCHEMA = "_id string, status string, customer string, items array<struct<sku:string,price:double,qty:double,tags:array<string>>>, total double, discount double, placed timestamp_ntz"


@pytest.fixture(scope="module")
def orders(spark):
    return Pipeline(spark.createDataFrame(ORDERS, SCHEMA))


def values(p, name):
    return [r[name] for r in (p.df if isinstance(p, Pipeline) else p).collect()]


def test_match_sort_count(orders):
    assert values(orders.match({"status": "paid"}).sort({"total": -1}), "total") == [25.0, 12.0]
    assert values(orders.match({"status": "paid"}).count("n"), "n") == [2]
    assert sorted(values(orders.match(lambda f: fn.gt(f.total, 20)), "total")) == [25.0, 30.0]


def test_group(orders):
    out = orders.sort({"total": -1}).group(lambda f: {"_id": f.status, "revenue": fn.sum(f.total), "best": fn.max(f.total), "top": fn.first_n(f.total, 2), "all": fn.push(f.discount)})
    paid = out.match({"_id": "paid"}).df.first()
    assert (paid.revenue, paid.best, paid.top, paid.all) == (37.0, 25.0, [25.0, 12.0], [0.1, None])
    assert orders.match({"total": -1}).group(lambda f: {"_id": None, "n": fn.count()}).exec() == []
    with pytest.raises(PipelineError):
        orders.group(lambda f: {"_id": None, "n": f.total})


def test_unwind(orders):
    assert values(orders.unwind("$items", include_array_index="i"), "i") == [0, 1, 0]
    assert values(orders.sort({"_id": 1}).unwind("items", "i", True), "i") == [0, 1, 0, None]


def test_buckets(orders):
    out = orders.bucket(lambda f: f.total, [0, 20, 100], output=lambda f: {"n": fn.count()})
    assert [(r["_id"], r["n"]) for r in out.df.collect()] == [(0, 1), (20, 2)]
    with pytest.raises(Exception, match="no bucket"):
        orders.bucket(lambda f: f.total, [0, 20]).df.collect()
    auto = orders.bucket_auto(lambda f: f.total, 2, granularity="R5").df.collect()
    assert auto[0]["_id"]["min"] == 10.0 and auto[-1]["_id"]["max"] == 40.0
    of = lambda v, name, up=True: orders.df.limit(1).select(granular(F.lit(v), name, up).alias("x")).first().x
    assert (of(8, "POWERSOF2"), of(8, "POWERSOF2", False), of(7, "1-2-5"), of(0, "R5")) == (16.0, 4.0, 10.0, 0.0)
    assert [of(v, "R40") for v in (1.12, 1.18, 1.25, 1.32, 1.5)] == [1.18, 1.25, 1.32, 1.4, 1.6] and of(38.0, "R80") == 38.7


def test_windows(orders):
    out = orders.match({"status": "paid"}).set_window_fields(lambda f: {"run": fn.with_window(fn.sum(f.total), documents=["unbounded", "current"]), "all": fn.push(f.total), "prev": fn.shift(f.total, -1)}, lambda f: f.status, {"placed": 1})
    assert [(r.run, r["all"], r.prev) for r in out.sort({"placed": 1}).df.collect()] == [(25.0, [25.0, 12.0], None), (37.0, [25.0, 12.0], 25.0)]
    with pytest.raises(PipelineError):
        orders.set_window_fields({"r": fn.rank()}, sort_by={"a": 1, "b": 1})


def test_densify_and_fill(spark):
    rows = [("s1", 0.0, 1.0), ("s1", 2.0, None), ("s1", 4.0, 5.0), ("s2", 1.0, 2.0)]
    p = Pipeline(spark.createDataFrame(rows, "sensor string, hour double, value double"))
    s1 = p.match({"sensor": "s1"}).densify("hour", 1, bounds="partition", partition_by_fields=["sensor"])
    assert sorted(values(s1, "hour")) == [0.0, 1.0, 2.0, 3.0, 4.0]
    linear = p.fill({"value": {"method": "linear"}}, partition_by_fields=["sensor"], sort_by={"hour": 1})
    assert values(linear.match({"sensor": "s1", "hour": 2.0}), "value") == [3.0]
    assert sorted(values(p.fill({"value": {"value": 0.0}}), "value")) == [0.0, 1.0, 2.0, 5.0]


def test_joins(orders, spark):
    people = Pipeline(spark.createDataFrame([("ann",), ("bob",), ("cid",)], "_id string"))
    out = people.lookup("o", orders.df, "_id", "customer").sort({"_id": 1})
    assert [len(x) for x in values(out, "o")] == [2, 1, 0]
    staff = spark.createDataFrame([("dev", "mid"), ("mid", "boss"), ("boss", None)], "name string, manager string")
    up = Pipeline(staff.where("name = 'dev'")).graph_lookup(staff, lambda f: f.manager, "manager", "name", "chain", depth_field="d")
    assert [(x["name"], x["d"]) for x in up.df.first().chain] == [("mid", 0), ("boss", 1)]
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "name string, manager string")
    assert len(Pipeline(cycle).graph_lookup(cycle, lambda f: f.manager, "manager", "name", "c").df.first().c) == 2
    lists = Pipeline(spark.createDataFrame([(["ann", "cid"],), (["zoe"],), (None,)], "ids array<string>")).lookup("p", people.df, "ids", "_id")
    assert sorted(len(x) for x in values(lists, "p")) == [0, 0, 2]
    assert orders.union_with(orders).df.count() == 6


def test_shapes(orders):
    out = orders.add_fields(lambda f: {"items.price": fn.literal(1.0), "meta.tag": fn.literal("t"), "status": REMOVE})
    assert "status" not in out.df.columns and out.df.first().items[0].price == 1.0 and out.df.first().meta.tag == "t"
    assert orders.project({"items.sku": 1}).df.first().items[0].asDict() == {"sku": "a"}
    assert orders.unset("items.price").df.schema["items"].dataType.elementType.fieldNames() == ["sku", "qty", "tags"]
    with pytest.raises(PipelineError):
        orders.project({"total": 1, "status": 0})
    with pytest.raises(PipelineError):
        orders.limit(1).geo_near({"type": "Point", "coordinates": [0, 0]}, "d", "at")


def test_filters(orders):
    df = orders.df
    ids = lambda spec: sorted(r._id for r in df.where(compile_filter(df, spec)).collect())
    assert ids({"discount": None}) == ["2", "3"] and ids({"discount": {"$ne": 0.1}}) == ["2", "3"]
    assert ids({"discount": {"$gt": 0}}) == ["1"] and ids({"discount": {"$not": {"$gt": 0}}}) == ["2", "3"]
    assert ids({"items.sku": "b"}) == ["1"] and ids({"items.tags": "x"}) == ["1"] and ids({"items.0.sku": "c"}) == ["2"]
    assert ids({"items": {"$size": 0}}) == ["3"] and ids({"items": {"$elemMatch": {"sku": "a", "price": {"$lt": 11}}}}) == ["1"]
    assert ids({"items.sku": {"$nin": ["a"]}}) == ["2", "3"] and ids({"status": {"$in": ["open", None]}}) == ["2"]
    assert ids({"$nor": [{"status": "open"}, {"total": 12}]}) == ["1"]
    for bad in ({"nope": 1}, {"total": {"$what": 1}}, {"$where": "1"}, {"$or": []}, {"total": {"$gt": 1, "x": 2}}, {"total": {"$mod": [0, 1]}}):
        with pytest.raises(FilterError):
            compile_filter(df, bad)


def test_expressions(spark):
    p = Pipeline(spark.createDataFrame([(5, -2.5, "héllo wörld", [3, 1, 2], datetime(2026, 3, 15, 1, 2, 3))], "i int, x double, s string, a array<int>, t timestamp_ntz"))
    out = p.project(lambda f: {"r": fn.round(f.x), "r2": fn.round(1234, -2), "w": fn.week(f.t), "sl": fn.slice(f.a, -2), "z": fn.zip([f.a, fn.reverse_array(f.a)]), "rg": fn.range(5, 0, -2), "e": fn.range(0, 5, -1), "ib": fn.index_of_bytes(f.s, "w"), "ic": fn.index_of_cp(f.s, "w"), "fa": fn.regex_find_all(f.s, "[lw]"), "parts": fn.date_to_parts(f.t), "ty": fn.typeOf(f.a), "b": fn.to_bool("false"), "sw": fn.switch([(fn.eq(f.i, 5), "five")]), "carry": fn.date_from_parts(2024, 14, 1)}).df.first()
    assert (out.r, out.r2, out.w, out.sl, out.rg, out.e) == (-2.0, 1200, 11, [1, 2], [5, 3, 1], [])
    assert out.z[0] == [3, 2] and (out.ib, out.ic) == (7, 6) and [m.idx for m in out.fa] == [2, 3, 6, 9]
    assert out.parts.year == 2026 and out.ty == "array" and out.b is True and out.sw == "five" and out.carry == datetime(2025, 2, 1)
    with pytest.raises(Exception, match="no branch"):
        p.project(lambda f: {"x": fn.switch([(fn.eq(f.i, 6), 1)])}).df.collect()
    for refused in (fn.accumulator, fn.function):
        with pytest.raises(NotImplementedError):
            refused()


def test_updates(orders):
    w = Writer(orders.df)
    out = {r._id: r for r in w.update_many({"status": "paid"}, {"$set": {"items.$[cheap].price": 0.0}, "$inc": {"total": 1}}, [{"cheap.price": {"$lt": 6}}]).collect()}
    assert [i.price for i in out["1"].items] == [10.0, 0.0] and out["1"].total == 26.0 and out["2"].total == 30.0
    assert w.update_one({"status": "paid"}, {"$unset": {"discount": 1}}).where("_id = '1'").first().discount is None
    assert w.update_many({"_id": "9"}, {"$set": {"total": 1.0}, "$setOnInsert": {"status": "new"}}, upsert=True).where("_id = '9'").first().status == "new"
    assert w.delete_one({"status": "paid"}).count() == 2 and w.delete_many({"status": "paid"}).count() == 1
    assert w.bulk_write([{"deleteOne": {"filter": {"_id": "1"}}}, {"updateMany": {"filter": {"status": "open"}, "update": {"$rename": {"status": "customer"}}}}]).where("_id = '2'").first().customer == "open"
    piped = w.update_many({"_id": "1"}, lambda p: p.set(lambda f: {"total": fn.multiply(f.total, 2)}))
    assert sorted(r.total for r in piped.collect()) == [12.0, 30.0, 50.0]
    for bad in ({"$set": {"total": 1}, "$inc": {"total": 1}}, {"$what": {"a": 1}}):
        with pytest.raises(UpdateError):
            w.update_many({"_id": "1"}, bad)
    with pytest.raises(UpdateError):
        w.update_many({}, {"$set": {"total": 1.0}})


def test_populate(spark, orders):
    people = spark.createDataFrame([("ann", 1), ("bob", 2)], "_id string, n int")
    own = spark.createDataFrame([("x", ["bob", "zoe", "ann"], {"k": "ann"}, "ann"), ("y", None, None, "zoe")], "_id string, friends array<string>, by map<string,string>, boss string")
    out = {r._id: r for r in populate(populate(populate(own, "friends", people), "by", people), "boss", people).collect()}
    assert [p.n for p in out["x"].friends] == [2, 1] and out["x"].by["k"].n == 1 and out["x"].boss.n == 1
    assert out["y"].friends is None and out["y"].boss is None
    kept = populate(own, "friends", people, retain_null_values=True).where("_id = 'x'").first()
    assert [p and p._id for p in kept.friends] == ["bob", None, "ann"]
    back = populate_virtual(people, "orders", orders.df, "_id", "customer", sort={"total": -1}, per_document_limit=1)
    assert {r._id: [o.total for o in r.orders] for r in back.collect()} == {"ann": [30.0], "bob": [12.0]}
    one = populate_by(own.withColumn("kind", F.lit("person")), "boss", "kind", {"person": people})
    assert '"n":1' in one.where("_id = 'x'").first().boss


def test_policies_and_pages(orders):
    c = Collection(orders.df, policies=Policies(hidden=("discount",), tenant=("customer", "ann")))
    assert "discount" not in c.find().df().columns and c.find().count() == 2
    rows, token = Collection(orders.df).find().sort({"status": 1}).keyset_page(2, secret=b"k")
    mark = token(rows.collect())
    rest, _ = Collection(orders.df).find().sort({"status": 1}).keyset_page(2, mark, secret=b"k")
    assert [r._id for r in rest.collect()] == ["3"]
    with pytest.raises(ValueError):
        Collection(orders.df).find().keyset_page(2, mark[:-2] + "AA", secret=b"k")


def test_sinks(orders, spark, tmp_path):
    totals = orders.group(lambda f: {"_id": f.status, "revenue": fn.sum(f.total)})
    path = str(tmp_path / "totals")
    assert {r._id: r.revenue for r in totals.out(path).collect()} == {"open": 30.0, "paid": 37.0}
    doubled = totals.add_fields(lambda f: {"revenue": fn.multiply(f.revenue, 2)}).merge(path)
    assert sorted(r.revenue for r in doubled.collect()) == [60.0, 74.0]
    new = spark.createDataFrame([("paid", 1.0), ("late", 2.0)], "_id string, revenue double")
    assert merged(totals.df, new, ["_id"], "keepExisting", "discard").count() == 2
    with pytest.raises(Exception, match="missing"):
        merged(totals.df, new, ["_id"], "merge", "fail").collect()
    m = Materialized(path, lambda s: totals, ["_id"], "replace")
    assert m.refresh(spark).count() == 2 and View("totals", lambda s: totals).ensure(spark).count() == 2


def test_change_log(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "_id string, v int")
    at = lambda n: datetime(2024, 1, n)
    log = spark.createDataFrame([("update", at(1), "a", ("a", 1), ("a", 5)), ("delete", at(2), "b", ("b", 2), None), ("insert", at(1), "c", None, ("c", 7))], log_schema(docs.schema))
    assert sorted((r._id, r.v) for r in apply_changes(docs, log).collect()) == [("a", 5), ("c", 7)]
    events = Pipeline(log).change_stream(full_document_before_change="required").df.where("operationType = 'update'").first()
    assert events.updateDescription.updatedFields == ["v"] and events.fullDocumentBeforeChange.v == 1


def pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "".join(x.split("]")[0] for x in plan.split("PushedFilters: [")[1:])


def test_conjuncts_reach_the_source(spark):
    """Ranges, lists, equality and expressions at the top of a match are handed to Parquet."""
    p = Pipeline.read(spark, "/root/testdata/sf0.001/lineitem.parquet")
    for spec, wanted in (({"l_quantity": {"$gt": 3, "$lte": 7}}, ["GreaterThan(l_quantity,3.0)", "LessThanOrEqual(l_quantity,7.0)"]), ({"l_quantity": {"$gte": 3}}, ["GreaterThanOrEqual"]), ({"l_quantity": {"$lt": 3}}, ["LessThan"]), ({"l_linenumber": {"$in": [1, 2]}}, ["In(l_linenumber, [1,2"]), ({"$or": [{"l_quantity": {"$lt": 3}}, {"l_tax": {"$gt": 0.01}}]}, ["Or(LessThan"]), (lambda f: fn.and_(fn.gt(f.l_quantity, 3), fn.lt(f.l_tax, 0.02)), ["GreaterThan(l_quantity,3.0)", "LessThan(l_tax,0.02)"])):
        got = pushed(p.match(spec).df)
        assert all(w in got for w in wanted), (spec, got)


def test_conditions_as_values_are_never_null(orders):
    for spec in ({"discount": {"$gt": 0}}, {"discount": {"$in": [0.1]}}, lambda f: f.discount > 0):
        got = orders.df.select(compile_filter(orders.df, spec, as_value=True).alias("x")).collect()
        assert sorted(r.x for r in got) == [False, False, True]


def test_joined_collections_are_scoped(orders, spark):
    people = Collection(spark.createDataFrame([("ann", None, "t1", 1), ("bob", "2024", "t1", 2), ("cid", None, "t2", 3)], "_id string, gone string, tenant string, pin int"), policies=Policies(hidden=("pin",), deleted_at="gone", tenant=("tenant", "t1")))
    seen = {r._id: [x.asDict() for x in r.who] for r in orders.lookup("who", people, "customer", "_id").df.collect()}
    assert seen == {"1": [{"_id": "ann", "gone": None, "tenant": "t1"}], "2": [{"_id": "ann", "gone": None, "tenant": "t1"}], "3": []}
    assert [r._id for r in orders.project({"_id": 1}).union_with(people).match({"tenant": "t1"}).df.collect()] == ["ann"]
    assert populate(orders.df, "customer", people).where("customer is not null").count() == 2
    assert populate_virtual(people.raw, "o", Collection(orders.df, policies=Policies(tenant=("status", "open"))), "_id", "customer", count=True).where("o > 0").count() == 1


def test_graph_lookup_over_repeated_nodes(spark):
    """Several documents under one node all come; null starts reach nothing; a depth bound ends the walk."""
    staff = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("b", "d", 3), ("c", None, 4), ("d", "a", 5)], "name string, up string, n int")
    walk = lambda **o: Pipeline(staff.where("name = 'a'")).graph_lookup(staff, lambda f: f.up, "up", "name", "chain", depth_field="d", **o).df.first().chain
    assert sorted((x.n, x.d) for x in walk()) == [(1, 2), (2, 0), (3, 0), (4, 1), (5, 1)]
    assert sorted(x.n for x in walk(max_depth=0)) == [2, 3]
    assert Pipeline(staff.where("name = 'c'")).graph_lookup(staff, lambda f: f.up, "up", "name", "chain").df.first().chain == []


def test_equal_lists_and_null_lists(spark):
    own = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [2, 1]), (4, []), (5, None)], "k int, ids array<int>")
    names = spark.createDataFrame([(1, "x"), (2, "y")], "_id int, name string")
    got = {r.k: r.ids and [x.name for x in r.ids] for r in populate(own, "ids", names).collect()}
    assert got == {1: ["x", "y"], 2: ["x", "y"], 3: ["y", "x"], 4: [], 5: None}


def test_a_write_that_fails_keeps_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "kept")
    replace_collection(spark.range(3).toDF("_id"), path)
    with pytest.raises(Exception, match="broken"):
        replace_collection(spark.range(2).select(F.raise_error(F.lit("broken")).alias("_id")), path)
    assert spark.read.parquet(path).count() == 3
    assert replace_collection(spark.range(5).toDF("_id"), path).count() == 5


def test_first_rows_of_groups_with_null_keys_and_ties(spark):
    p = Pipeline(spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", None), ("a", 2), ("b", None)], "k string, v int"))
    out = p.sort({"v": 1}).group(lambda f: {"_id": f.k, "low": fn.min_n(f.v, 1), "top": fn.max_n(f.v, 5), "first": fn.first_n(f.v, 2), "last": fn.top_n(f.v, {"v": -1}, 1), "n": fn.count()})
    got = {r._id: (r.low, r.top, r.first, r["last"], r.n) for r in out.df.collect()}
    assert got == {None: ([1], [3, 1], [1, 3], [3], 2), "a": ([2], [2, 2], [None, 2], [2], 3), "b": ([], [], [None], [None], 1)}


def test_group_percentiles_are_exact_over_more_values_than_a_sketch_holds(spark):
    rows = spark.range(200_003).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") * 9_973 % 200_003).alias("x"))
    p = Pipeline(rows).group(lambda f: {"_id": fn.cond(fn.eq(f.k, 2), None, f.k), "n": fn.count(), "m": fn.median(f.x), "p": fn.percentile(f.x, [0, 0.001, 0.25, 0.9, 1])})
    own = {}
    for i in range(200_003):
        own.setdefault(None if i % 3 == 2 else i % 3, []).extend([i * 9_973 % 200_003] if i % 7 else [])
    at = lambda xs, num, den: sorted(xs)[max(-(-len(xs) * num // den), 1) - 1]
    assert {r["_id"]: (r.m, r.p) for r in p.df.collect()} == {k: (at(xs, 1, 2), [at(xs, *q) for q in ((0, 1), (1, 1000), (1, 4), (9, 10), (1, 1))]) for k, xs in own.items()}


def test_group_percentiles_of_no_values_are_null(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), ("b", float("nan"))], "k string, x double")
    got = Pipeline(rows).group(lambda f: {"_id": f.k, "m": fn.median(f.x), "p": fn.percentile(f.x, [0.5])}).df.collect()
    assert {r["_id"]: (r.m, r.p) for r in got} == {"a": (None, None), "b": (2.0, [2.0])}


def test_bulk_save_updates_loaded_documents_and_inserts_new_ones(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (2, 3), (9, 4), (None, 5)], "k long, v int")
    save = [{"k": 2, "v": 20}, {"k": 2, "v": 21}, {"k": 7, "v": 70}]
    got = Writer(rows, "k").bulk_save(save, new=[{"k": 9, "v": 90}]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1), (2, 21), (2, 21), (9, 4), (None, 5), (9, 90)], key=repr)
    assert Writer(rows, "k").bulk_save([{"k": 1}]).where("k = 1").collect()[0].v is None
