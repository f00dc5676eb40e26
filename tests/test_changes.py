"""Change operators, catalog, procedures, partitions, sketches and search by small cases with known answers."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillon.functions import predicates as P
from quillon.functions import scalars as S
from quillon.operators import analytics as A
from quillon.operators import dml as D
from quillon.operators.catalog import RowPolicies, Sequence, Tables, show_create
from quillon.operators.cursors import limited
from quillon.operators.joins import bloom_join
from quillon.operators.partitions import HashPartitioned, RangePartitioned
from quillon.operators.procedures import Routines
from quillon.operators.recursion import depth_first, has_cycle, shortest_routes
from quillon.operators.scans import json_nodes
from quillon.operators.windows import exclude_peers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def pair(spark):
    t = spark.createDataFrame([(None, "n"), (1, "a"), (2, None), (None, "m")], "k int, v string")
    s = spark.createDataFrame([(1, "x"), (1, "w"), (None, "p"), (None, "q"), (3, "z"), (3, "y")], "k int, v string")
    return t, s


def test_merge_with_null_and_repeated_keys(pair):
    t, s = pair
    want = sorted([(None, "n"), (None, "m"), (1, "w"), (2, None), (3, "y"), (None, "p"), (None, "q")], key=str)
    assert rows(D.merge(t, s, "k", {"v": F.col("s.v")}, order=["v"])) == want
    assert rows(D.upsert(t, s, "k", {"v": F.col("excluded.v")}, order=["v"])) == want
    assert rows(D.merge(t, s, "k", {"v": F.col("s.v")}, insert=False, order=["v"])) == sorted([(None, "n"), (None, "m"), (1, "w"), (2, None)], key=str)
    assert rows(D.upsert(t, s, "k", order=["v"])) == sorted([(None, "n"), (None, "m"), (1, "a"), (2, None), (3, "y"), (None, "p"), (None, "q")], key=str)
    assert rows(D.merge(t.limit(0), s, "k", {}, order=["v"])) == sorted([(1, "w"), (3, "y"), (None, "p"), (None, "q")], key=str)


def test_returning_and_insert(pair):
    t, _ = pair
    after, changed = D.update_where(t, {"v": F.lit("new")}, F.col("k") > 1)
    assert rows(changed) == [(2, "new")] and rows(after) == sorted([(None, "n"), (None, "m"), (1, "a"), (2, "new")], key=str)
    after, gone = D.delete_where(t, F.col("k") > 1)
    assert rows(gone) == [(2, None)] and after.count() == 3
    assert rows(D.insert_values(t, [{"k": 7}, {"v": "z"}], {"v": F.lit("d")})) == sorted([(7, "d"), (None, "z")], key=str)
    with pytest.raises(ValueError):
        D.insert_values(t, [{"nothing": 1}])
    with pytest.raises(ValueError):
        D.GeneratedColumns({"v": F.lit(1)}).stored(t)


def test_catalog(spark):
    t = Tables(spark)
    r = spark.range(3)
    t.drop("quillon_t", if_exists=True)
    t.create("quillon_t", r)
    with pytest.raises(ValueError):
        t.create("quillon_t", r)
    assert t.create("quillon_t", r.limit(0), if_not_exists=True).count() == 3
    t.comment("quillon_t", "three")
    assert t.show().filter("table_name = 'quillon_t'").first().comment == "three"
    assert "`id` BIGINT" in show_create(spark, "quillon_t") and rows(t.describe("quillon_t"))[0][:2] == ("id", "bigint")
    t.drop("quillon_t")
    with pytest.raises(ValueError):
        t.drop("quillon_t")
    p = RowPolicies()
    p.add("r", "a", F.col("id") > 1)
    assert (p.read("r", r, "a").count(), p.read("r", r, "b").count(), p.read("other", r, "b").count()) == (1, 0, 3)


def test_procedures(spark):
    p = Routines(spark)
    p.create("twice", [("x", "INT")], "SELECT x * 2 AS y;")
    assert p.call("twice", 4).first().y == 8 and p.call("twice", None).first().y is None
    for bad in (lambda: p.call("twice"), lambda: p.call("none"), lambda: p.create("twice", [], "SELECT 1"), lambda: p.drop("none")):
        with pytest.raises(ValueError):
            bad()


def test_partitions_prune_and_keep_all(spark):
    d = spark.createDataFrame([(i, None if i == 5 else i * 10) for i in range(10)], "id int, v int")
    r = RangePartitioned(spark, "v", [30, 60]).write(d)
    assert r.read().count() == 10 and [x[0] for x in rows(r.between(30, 60))] == [3, 4, 6]
    plan = r.between(0, 10)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "__part" in plan
    h = HashPartitioned(spark, "v", 4).write(d)
    assert h.read().count() == 10 and rows(h.equal(40)) == [(4, 40)] and h.equal(41).count() == 0


def test_graphs(spark):
    e = lambda *xs: spark.createDataFrame([(a, b, float(w)) for a, b, w in xs], "src long, dst long, weight double")
    ring = e((1, 2, 1), (2, 3, 1), (3, 1, 1))
    assert has_cycle(ring) and not has_cycle(ring.filter("src < 3")) and has_cycle(e((4, 4, 1)))
    got = {r.node: (r.cost, r.path) for r in shortest_routes(e((1, 2, 5), (1, 3, 1), (3, 2, 2), (2, 4, 1), (9, 1, 1)), spark.range(1, 2)).collect()}
    assert got == {1: (0.0, [1]), 3: (1.0, [1, 3]), 2: (3.0, [1, 3, 2]), 4: (4.0, [1, 3, 2, 4])}
    assert [r.node for r in depth_first(e((1, 2, 1), (1, 5, 1), (2, 3, 1), (3, 1, 1)), spark.range(1, 2)).orderBy("path").collect()] == [1, 2, 3, 5]


def test_sketches(spark):
    d = spark.createDataFrame([(i % 40,) for i in range(4000)] + [(None,)], "v int")
    b = A.bloom_merge(A.bloom_filter(d.filter("v < 20"), "v", 100), A.bloom_filter(d.filter("v >= 20"), "v", 100))
    assert A.might_contain(d, "v", b).count() == 4000
    assert A.might_contain(spark.range(1000, 2000).select(F.col("id").cast("int").alias("v")), "v", b).count() <= 40
    assert A.might_contain(d, "v", A.bloom_filter(d.limit(0), "v")).count() == 0
    est = A.count_min_estimate(A.count_min(d, "v", 16, 3), d.filter("v IS NOT NULL"), "v", 16, 3).collect()
    assert len(est) == 40 and all(r.estimate >= 100 for r in est)
    h = A.equi_height_histogram(spark.range(1000).toDF("v"), "v", 10)
    assert sum(r.n for r in h.collect()) == 1000 and abs(A.range_estimate(h, 100, 299).first()[0] - 200) < 10


def test_stems_and_text_queries(spark):
    d = spark.createDataFrame([("The runner was running in licensed shoes",), ("grass",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(P.stem(F.lit("running"))).limit(1).collect()] == ["runn"]
    assert d.filter(P.match_stems(F.col("t"), "licenses shoe")).count() == 1
    hit = lambda q: d.filter(P.ts_query(F.col("t"), q)).count()
    assert (hit("running & shoes"), hit("running & !shoes"), hit("grass | runner"), hit("licensed <-> shoes"), hit("shoes <-> licensed"), hit("(grass | shoes) & runner")) == (1, 0, 2, 1, 0, 1)


def test_json(spark):
    assert [(r[0], r[2], r[6]) for r in json_nodes('{"a":[1,{"b":null}],"c":true}', "$", True)] == [
        (None, "object", "$"), ("a", "array", "$.a"), ("0", "integer", "$.a[0]"), ("1", "object", "$.a[1]"), ("b", "null", "$.a[1].b"), ("c", "true", "$.c")
    ]
    assert [r[0] for r in json_nodes('{"a":[1,2]}', "$.a", False)] == ["0", "1"] and list(json_nodes("{bad", "$", True)) == [] and list(json_nodes("{}", "$.x", True)) == []
    assert S.contains({"a": [1, {"b": 2}], "c": 0}, {"a": [{"b": 2}]}) and not S.contains({"a": 1}, {"a": True}) and not S.contains([1], [2])


def test_documents(spark):
    d = spark.createDataFrame([('{"k":5,"s":"x"}',), ('{"s":"y"}',), ("bad",), (None,)], "j string")
    assert A.doc_find(d, "j", {"k": {"$ne": 5}}).count() == 3 and A.doc_find(d, "j", {"s": {"$in": ["x", "y"]}}).count() == 2 and A.doc_find(d, "j", {"k": {"$exists": False}}).count() == 3
    got = [r.j for r in A.doc_update(d, "j", {"s": "x"}, {"$inc": {"k": 2, "n": 1, "s": 1}, "$unset": {"z": ""}, "$set": {"t": "u"}}).collect()]
    assert got == ['{"k":7,"s":"x","t":"u","n":1}', '{"s":"y"}', "bad", None]


def test_change_log_and_cache(spark):
    log = A.ChangeLog("id")
    log.capture(spark.range(0), spark.range(3))
    log.capture(spark.range(3), spark.range(1, 4))
    assert rows(log.changes(3)) == [(0, "delete", 4), (3, "insert", 5)]
    cache = A.ResultCache(most=1)
    cache.get("a", ("t",), lambda: spark.range(1))
    cache.get("b", ("t",), lambda: spark.range(2))
    assert cache.get("b", ("t",), None).count() == 2 and list(cache.kept) == ["b"]


def test_excluded_peers_with_ties(spark):
    d = spark.createDataFrame([(1, 1, 5.0), (2, 1, 3.0), (3, 2, 9.0)], "id int, k int, v double").withColumn("g", F.lit(0))
    got = lambda keep: {r.id: (r.x_count, r.x_min) for r in exclude_peers(d, ["g"], "k", "id", -1, 1, "v", "x", keep, "range").collect()}
    assert got(True) == {1: (2, 5.0), 2: (2, 3.0), 3: (3, 3.0)} and got(False) == {1: (1, 9.0), 2: (1, 9.0), 3: (2, 3.0)}


def test_ordered_comparisons(spark):
    d, v = spark.range(5), spark.createDataFrame([(1,), (3,), (None,)], "v int")
    n = lambda op, every, w=v: P.ordered(d, w, F.col("id"), op, every).count()
    assert (n("<", False), n(">", False), n("<=", False), n(">=", False)) == (3, 3, 4, 4)
    assert n("<", True) == 0 and n("<", True, v.na.drop()) == 1 and n(">=", True, v.na.drop()) == 2 and n(">", True, v.limit(0)) == 5 and n(">", False, v.limit(0)) == 0


def test_limits_and_rejections(spark):
    d = spark.range(5)
    assert (limited(d, None, -2).count(), limited(d, spark.range(3).agg(F.count("id")), 1).count(), limited(d, 0).count()) == (5, 3, 0)
    for bad in ("SELECT id FROM range(3) WHERE row_number() OVER (ORDER BY id) = 1", "SELECT sum(count(id)) FROM range(3)"):
        with pytest.raises(AnalysisException):
            spark.sql(bad).collect()


def test_age(spark):
    d = lambda a, b: spark.range(1).select(S.age(F.lit(a).cast("date"), F.lit(b).cast("date"))).first()[0]
    assert d("2024-03-04", "2023-02-01") == "1 year 1 mon 3 days" and d("2024-03-01", "2024-03-01") == "0 days" and d("2024-03-01", "2024-02-28") == "3 days"


def test_sequences():
    s = Sequence(start=1, step=2, most=4, least=1, cycle=True)
    with pytest.raises(ValueError):
        s.currval()
    assert [s.nextval() for _ in range(3)] == [1, 3, 1] and s.currval() == 1
    s.setval(2, called=False)
    assert s.nextval() == 2
    with pytest.raises(ValueError):
        end = Sequence(most=1)
        end.nextval(), end.nextval()


def test_bloom_join_keeps_every_pair(spark):
    left = spark.createDataFrame([(i % 50 if i % 7 else None, i) for i in range(300)], "k int, a int")
    right = spark.createDataFrame([(3, "x"), (3, "y"), (49, "z"), (None, "n")], "k int, b string")
    assert rows(bloom_join(left, right, "k")) == rows(left.join(right, "k")) and bloom_join(left, right.limit(0), "k").count() == 0


def test_strftime(spark):
    t = F.lit("2024-03-05 14:07:09").cast("timestamp_ntz")
    assert spark.range(1).select(S.strftime("%F %T %I%p %w %% %s x", t)).first()[0] == "2024-03-05 14:07:09 02PM 2 % 1709647629 x"
    assert spark.range(1).select(F.trim(S.number_to_char(F.lit(1234.5), "999,990.00"))).first()[0] == "1,234.50"
