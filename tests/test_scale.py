"""Steps that once grew with the square of a group or carried a whole table with each row."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import predicates as P
from quillon.operators import analytics as A
from quillon.operators.joins import bloom_join, spread_join
from quillon.operators.windows import exclude_peers
from quillon.plans import registry

registry.load()


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_bloom_filter_is_not_carried_by_rows(spark):
    d = spark.range(3000)
    b = A.bloom_filter(d, "id", 3000)
    found = A.might_contain(spark.range(-3000, 3000), "id", b)
    assert found.filter("id >= 0").count() == 3000 and found.filter("id < 0").count() <= 90
    assert "Join" not in plan(found) and "map_from_entries" not in plan(found)
    one = A.bloom_filter(d.limit(1), "id", 200_000)
    assert A.might_contain(d, "id", one).count() == 1
    bits = {r.word * 64 + i for r in b.collect() for i in range(64) if r.mask >> i & 1}
    at = spark.range(-3000, 3000).select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(b.first().bits)) for i in range(b.first().hashes)]).alias("p"))
    assert {r.id for r in found.collect()} == {r.id for r in at.collect() if bits.issuperset(r.p)}


def test_bloom_join_has_one_join(spark):
    left, right = spark.range(500).withColumn("v", F.col("id") * 2), spark.range(100, 120)
    joined = bloom_join(left, right, "id")
    assert sorted(r.v for r in joined.collect()) == [2 * i for i in range(100, 120)]
    assert joined._jdf.queryExecution().executedPlan().toString().count("NestedLoopJoin") == 0


def held_against_sql(spark, name, tmp_path, **tables):
    """A query's rows against its SQL, over tables written here."""
    import duckdb

    c = duckdb.connect()
    for t, d in tables.items():
        d.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    r = c.execute(registry.ORACLE[name])
    names = [x[0] for x in r.description]
    got = registry.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    key = lambda row: [(x is None, 0 if x is None else x) for x in row]
    assert sorted((tuple(x) for x in got), key=key) == sorted(r.fetchall(), key=key)
    return got


TEXTS = ["MIT License", "the mit\n--license.", "mit licenses", "mits license", "MIT xlicense", "submit license", "license mit", "mit", "mit and license", "Apache", "apache versions", "Apache, Version 2", "apaches", "apache versioned", "mit license apache version", "", None, "M\u0130T License"]


def test_phrases_in_one_pass(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert {r.doc_id for r in held_against_sql(spark, "text_phrase", tmp_path, documents=docs)} == {0, 1, 14, 17}
    assert "sequence" not in plan(A.phrase_search(docs, ["mit", "license"]))
    assert A.phrase_search(docs, []).count() == 17 and A.phrase_search(docs, ["mit license"]).count() == 0


def test_text_query_by_words_as_they_are(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert {r.doc_id for r in held_against_sql(spark, "pred_ts_query", tmp_path, documents=docs)} == {0, 1, 9, 10, 13, 14, 17}
    hit = lambda q, stems: docs.filter(P.ts_query(F.col("text"), q, stems)).count()
    assert (hit("version", True), hit("version", False), hit("!mit", False), hit("mit <-> license", True)) == (4, 2, 8, 5)


def test_range_frames_without_peers(spark, tmp_path):
    part = spark.createDataFrame([(i, f"b{i % 3}" if i % 11 else None, (i * 7) % 13 if i % 10 else None, float(i * 37 % 101) if i % 9 else None) for i in range(300)], "p_partkey long, p_brand string, p_size int, p_retailprice double")
    held_against_sql(spark, "win_exclude_ties", tmp_path / "t", part=part)
    held_against_sql(spark, "win_exclude_group", tmp_path / "g", part=part)
    for kind in ("int", "double"):
        for start, end, keep in ((-3, 3, True), (-3, 3, False), (-5, -2, True), (1, 4, False), (0, 0, True)):
            d = part.withColumn("p_size", F.col("p_size").cast(kind))
            got = {r.p_partkey: (r.x_count, r.x_min) for r in exclude_peers(d, ["p_brand"], "p_size", "p_partkey", start, end, "p_retailprice", "x", keep, "range").collect()}
            rows = d.collect()
            for r in rows:
                near = (lambda s: s is None) if r.p_size is None else (lambda s: s is not None and start <= s - r.p_size <= end)  # noqa: B023
                own = keep and (r.p_size is None or start <= 0 <= end)
                v = [x.p_retailprice for x in rows if x.p_brand == r.p_brand and near(x.p_size) and (x.p_size != r.p_size or own and x.p_partkey == r.p_partkey)]
                assert got[r.p_partkey] == (len(v), min((x for x in v if x is not None), default=None)), (kind, start, end, keep, r)
    assert "collect_list" not in plan(exclude_peers(part, ["p_brand"], "p_size", "p_partkey", -3, 3, "p_retailprice", "x", True, "range"))


def test_estimates_keep_no_sketch_for_each_key(spark, tmp_path):
    o = spark.createDataFrame([(i, i % 700 if i % 5 else None) for i in range(4000)], "o_orderkey long, o_custkey long")
    lines = spark.createDataFrame([(i % 50, i % 7) for i in range(4000)], "l_partkey long, l_linenumber int")
    for name, t, sketch in (("sketch_approx_distinct", {"orders": o}, "approx_count_distinct"), ("sketch_cardinality_multi", {"lineitem": lines}, "hll_sketch_agg")):
        held_against_sql(spark, name, tmp_path / name, **t)
        held_against_sql(spark, name, tmp_path / f"{name}-empty", **{k: d.limit(0) for k, d in t.items()})
        executed = registry.QUERIES[name](spark, str(tmp_path / name))._jdf.queryExecution().sparkPlan().toString()
        assert not [line for line in executed.splitlines() if sketch in line and "keys=[]" not in line and "Aggregate(" in line]


def test_spread_joins(spark):
    left = spark.createDataFrame([(i % 5 if i % 6 else None, i) for i in range(120)] + [(77, -1)], "k int, a long")
    right = spark.createDataFrame([(i % 4 + 2 if i % 7 else None, i) for i in range(90)] + [(88, -2), (88, -2)], "k int, b long")
    bag = lambda d: sorted(tuple(r) for r in d.select(F.coalesce("a", F.lit(-9)), F.coalesce("b", F.lit(-9))).collect())
    for pairs in (10, 10**9):
        assert bag(spread_join(left, right, "k", how="full", pairs=pairs)) == bag(left.join(right, "k", "full"))
        assert bag(spread_join(left, right, "k", F.col("a") < F.col("b"), pairs=pairs)) == bag(left.alias("x").join(right.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("a") < F.col("b")), "left"))
    assert bag(spread_join(left.limit(0), right, "k", how="full")) == bag(right.withColumn("a", F.lit(None)))
    assert bag(spread_join(left, right.limit(0), "k", how="full")) == bag(left.withColumn("b", F.lit(None)))
    one = spark.range(400).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    dealt = spread_join(one, one.select("k", F.col("a").alias("b")), "k", pairs=10_000)
    assert dealt.count() == 160_000 and dealt.select(F.spark_partition_id()).distinct().count() > 4


def test_null_keys_against_sql(spark, tmp_path):
    part = spark.createDataFrame([(i, i % 9 if i % 8 else None) for i in range(200)], "p_partkey long, p_size int")
    assert len(held_against_sql(spark, "join_null_keys", tmp_path, part=part)) > 200
    assert "repartition" in plan(registry.QUERIES["join_null_keys"](spark, str(tmp_path))).lower()


def test_minhash_pairs_move_a_set_once_for_each_bucket(spark):
    of = {i: {f"w{k}" for k in range(40)} | {f"x{i % 12}"} for i in range(36)} | {100 + i: {f"y{i // 2}-{k}" for k in range(9)} for i in range(6)}
    sets = spark.createDataFrame([(i, sorted(w)) for i, w in of.items()], "id long, w array<string>").withColumn("s", A.minhash(F.col("w")))
    pairs = A.minhash_pairs(sets)
    got = [(r.id_a, r.id_b, r.exact) for r in pairs.collect()]
    want = [(a, b, len(of[a] & of[b]) / len(of[a] | of[b])) for a in of for b in of if a < b and of[a] & of[b]]
    assert sorted(got) == sorted(want)
    assert "bit_xor" in plan(pairs)
