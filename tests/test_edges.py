"""Edge cases: nulls, empty inputs, ties and patterns with special characters."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import predicates as P
from quillon.functions import scalars as S
from quillon.operators import analytics as A
from quillon.operators import dml as D
from quillon.operators.joins import asof_join, band_join, salted_join
from quillon.operators.recursion import bfs_levels, min_label_components, recursive_union, shortest_paths, topological_levels
from quillon.operators.windows import distinct_on, exclude_peers, groups_frame


@pytest.mark.parametrize("pattern,text,want", [("a*", "abc", True), ("a?c", "abc", True), ("[!a]*", "abc", False), ("a.c", "abc", False), ("*%_", "x%_", True), ("[]", "[]", True)])
def test_glob(pattern, text, want):
    assert bool(re.match(P.glob_to_regex(pattern), text)) is want


@pytest.mark.parametrize("pattern,text,want", [("a%", "abc", True), ("a_c", "abc", True), ("(ab|cd)+", "abcd", True), ("a.c", "abc", False), ("%b", "ab", True)])
def test_similar_to(pattern, text, want):
    assert bool(re.match(P.similar_to_regex(pattern), text)) is want


def test_all_and_any_with_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    values = spark.createDataFrame([(3,), (None,)], "v int")
    none = values.limit(0)
    bigger = lambda v: F.col("x") > v
    assert P.all_of(rows, none, bigger).count() == 3
    assert P.any_of(rows, none, bigger).count() == 0
    assert P.all_of(rows, values, bigger).count() == 0
    assert [r.x for r in P.any_of(rows, values, bigger).collect()] == [5]


def test_between_symmetric_null_bound(spark):
    d = spark.createDataFrame([(1, 5), (7, None)], "x int, b int")
    assert [r.x for r in d.filter(P.between_symmetric(F.lit(3), F.col("b"), F.col("x"))).collect()] == [1]


def test_joins_on_empty_and_null_keys(spark):
    left = spark.createDataFrame([(1, 10.0), (None, 3.0)], "k int, t double")
    right = spark.createDataFrame([(1, 5.0, "a"), (1, 10.0, "b"), (1, 10.0, "c")], "k int, t double, v string")
    got = {(r.k, r.last) for r in asof_join(left, right, "k", "t", "v", "last").collect()}
    assert got == {(1, "c"), (None, None)}
    assert asof_join(left, right.limit(0), "k", "t", "v", "last").filter("last is not null").count() == 0
    assert salted_join(left.select("k"), right.select("k"), "k").count() == 3
    bands = spark.createDataFrame([(0, 25), (5, 5)], "lo int, hi int")
    assert band_join(spark.createDataFrame([(5,), (25,), (26,)], "x int"), bands, "x", "lo", "hi", 10).count() == 3


def test_frames_with_ties_and_single_rows(spark):
    d = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", 9, 4)], "g string, o int, i int")
    got = {r.i: r.n for r in groups_frame(d, ["g"], "o", -1, 0, {"n": F.count(F.lit(1))}).collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 1}
    got = {r.i: (r.x_count, r.x_min) for r in exclude_peers(d, ["g"], "o", "i", -1, 1, "i", "x", False).collect()}
    assert got[4] == (0, None) and got[1] == (0, None) and got[3] == (1, 2)
    assert distinct_on(d, ["g"], [F.desc("o")]).count() == 2


def test_recursion_and_graphs_with_cycles(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (1, 3, 5.0), (7, 8, 1.0)], "src long, dst long, weight double")
    start = spark.createDataFrame([(1,)], "node long")
    reach = recursive_union(start, lambda n: n.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")))
    assert {r.node for r in reach.collect()} == {1, 2, 3}
    assert {(r.node, r.level) for r in bfs_levels(e, start).collect()} == {(1, 0), (2, 1), (3, 1)}
    assert {(r.node, r.cost) for r in shortest_paths(e, start).collect()} == {(1, 0.0), (2, 1.0), (3, 2.0)}
    assert {(r.node, r.component) for r in min_label_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert {(r.node, r.level) for r in topological_levels(e).collect()} == {(7, 0), (8, 1)}


def test_changes_with_null_keys_and_duplicates(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "m")], "k int, v string")
    assert D.upsert(t, s.filter("k is not null"), "k").count() == 3
    assert {(r.k, r.v) for r in D.upsert(t, s.filter("k = 1"), "k", {"v": F.col("excluded.v")}).collect()} == {(1, "x"), (None, "n")}
    assert D.merge(t.filter("k = 1"), s.filter("k = 2").limit(1), "k", {}).count() == 2
    assert D.delete_using(t, s, "k").count() == 1
    assert D.violations(t, {"v": F.col("k") > 1}, "v").count() == 1
    assert sorted(r.n for r in D.with_sequence(s, ["v"], "n").collect()) == [1, 2, 3, 4]


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        S.gcd(F.lit(0), F.lit(0)).alias("g"), S.lcm(F.lit(4), F.lit(6)).alias("l"), S.trunc_number(F.lit(-2.59), 1).alias("t"), S.quote(F.lit("it's")).alias("q"),
        S.age(F.lit("2024-03-01").cast("date"), F.lit("2022-12-31").cast("date")).alias("a"), S.array_position_or_null(F.array(F.lit(1)), F.lit(2)).alias("p"),
        S.json_set(F.lit('{"a":[1]}'), "$.a[1]", 2).alias("s"), S.json_set(F.lit("bad"), "$.a", 2).alias("b"), S.json_path("$..x")(F.lit('{"a":{"x":1},"x":[2]}')).alias("x"),
        S.regexp_replace_first(F.lit("a1b2"), "[0-9]", "#").alias("r"), S.concat_skip_null(F.lit(None).cast("string"), F.lit("z")).alias("c"),
    ).first()
    assert (row.g, row.l, row.t, row.q, row.p, row.s, row.b, row.x, row.r, row.c) == (0, 12, -2.5, "'it''s'", None, '{"a":[1,2]}', None, "[[2],1]", "a#b2", "z")
    assert row.a == "1 years 2 mons" or row.a.startswith("1 years 2 mons")


def test_vectors_and_text_with_zero_and_empty(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in A.nearest(v, [1.0, 0.0], 5).collect()] == [(2, 1.0), (1, 0.0)]
    d = spark.createDataFrame([(1, None), (2, ""), (3, "The license"), (4, "license mit license")], "doc_id long, text string")
    assert {r.doc_id for r in A.tf_idf_search(d, ["license", "mit"]).collect()} == {3, 4}
    assert {r.doc_id for r in A.phrase_search(d, ["license", "mit"]).collect()} == {4}
    assert A.merge_intervals(spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 7, 8)], "k string, s int, e int"), "k", "s", "e").count() == 2


def test_minhash_takes_every_document(spark, tmp_path):
    import itertools

    from quillon.plans import registry

    registry.load()
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words + [f"x{i}"]) for i in range(6)] + [" ".join(f"y{i}_{k}" for k in range(60)) for i in range(6)] + [" ".join(words + ["x0"]), None, ""]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.near for r in registry.QUERIES["sketch_minhash"](spark, str(tmp_path)).collect()] == [True]
    sets = docs.filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.array_distinct(F.split("text", " ")).alias("w")).withColumn("s", A.minhash(F.col("w")))
    got = {(r.id_a, r.id_b): r.exact for r in A.minhash_pairs(sets).collect()}
    of = {100 + i: set(t.split(" ")) for i, t in enumerate(texts) if t is not None}
    assert got == {(a, b): len(of[a] & of[b]) / len(of[a] | of[b]) for a, b in itertools.combinations(of, 2) if of[a] & of[b]}
