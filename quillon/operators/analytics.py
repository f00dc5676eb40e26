"""Time series, vectors, text search, documents, sketches and change capture."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.functions.predicates import words_in_row
from quillon.functions.scalars import json_add, json_remove, json_set
from quillon.operators.dml import unused, with_sequence
from quillon.operators.recursion import written

# Words that text search passes over.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on or that the this to was were will with".split()


# time series
def downsample(df: DataFrame, metric: str, ts: str, value: str, seconds: int) -> DataFrame:
    """Aggregates by metric and epoch-aligned bucket; empty buckets are absent."""
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds
    return df.groupBy(metric, bucket.alias("bucket")).agg(
        F.avg(value).alias("avg"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n")
    )


def range_query(df: DataFrame, ts: str, start: str, end: str, **tags: object) -> DataFrame:
    """Points from start to end, both included, with these tags."""
    out = df.filter(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    for k, v in tags.items():
        out = out.filter(F.col(k) == F.lit(v))
    return out


def latest(df: DataFrame, metric: str, ts: str, value: str, tie: str) -> DataFrame:
    """The newest value of each metric; the larger ``tie`` wins among equal times. One pass, no sort."""
    return df.groupBy(metric).agg(F.max_by(value, F.struct(ts, tie)).alias("latest"), F.max(ts).alias("at"))


def gap_fill(df: DataFrame, metric: str, bucket: str, step: int, value: str) -> DataFrame:
    """A row for every bucket between a metric's first and last; missing ones carry the value before them."""
    ends = df.groupBy(metric).agg(F.min(bucket).alias("a"), F.max(bucket).alias("b"))
    grid = ends.select(metric, F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias(bucket))
    w = W.partitionBy(metric).orderBy(bucket)
    return grid.join(df, [metric, bucket], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


# vectors
def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def nearest(vectors: DataFrame, query: list[float], k: int, measure: str = "cosine", where: Column | None = None, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest vectors: score, id. Top-k is kept per task, then merged; nothing is sorted whole."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = {"cosine": cosine, "dot": dot, "euclidean": euclidean}[measure](F.col(vec), q)
    d = vectors if where is None else vectors.filter(where)
    order = F.asc("raw") if measure == "euclidean" else F.desc("raw")
    return d.select(key, score.alias("raw")).orderBy(order, key).limit(k).select(key, F.round("raw", 6).alias("score"))


def matrix_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse product of (i, j, v) matrices."""
    r = b.select(F.col("i").alias("j"), F.col("j").alias("c"), F.col("v").alias("w"))
    return a.join(r, "j").groupBy("i", F.col("c").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def box_search(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    x0, y0, x1, y1 = box
    return df.filter(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def nearest_points(df: DataFrame, x: str, y: str, at: tuple[float, float], k: int, key: str) -> DataFrame:
    d = (F.col(x) - at[0]) * (F.col(x) - at[0]) + (F.col(y) - at[1]) * (F.col(y) - at[1])
    return df.withColumn("d2", d).orderBy("d2", key).limit(k)


def merge_intervals(df: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a key as one."""
    w = W.partitionBy(by).orderBy(start, end)
    far = df.withColumn("__m", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)))
    island = far.withColumn("__i", F.sum(F.when(F.col(start) <= F.col("__m"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(by, "__i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__i")


# text search
def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf, doc_len: an inverted index without stop words; terms are runs of ASCII letters and digits."""
    terms = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))
    d = docs.select(key, terms.alias("ts"))
    return d.select(key, F.size("ts").cast("long").alias("doc_len"), F.explode("ts").alias("term")).groupBy(key, "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def _equal(word: str):
    return lambda t: t == F.lit(word)


def tf_idf_search(docs: DataFrame, query: list[str], mode: str = "or", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with any or all query terms, scored by tf / length times ln((N + 1) / (df + 1)) + 1.

    One pass counts the query's terms in each document as an array; only documents
    that hold one go on, and only N and the terms' document counts are aggregated.
    """
    asked = sorted(set(query))
    terms = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))
    counted = docs.select(key, terms.alias("ts")).select(key, F.size("ts").alias("len"), F.array(*[F.size(F.filter("ts", _equal(q))) for q in asked]).alias("tf"))
    hits = written(counted.filter(F.exists("tf", lambda n: n > 0)))
    dfs = [F.coalesce(F.sum((F.col("tf")[i] > 0).cast("long")), F.lit(0)) for i in range(len(asked))]
    stats = hits.agg(F.array(*dfs).alias("df")).crossJoin(docs.agg(F.count(F.lit(1)).alias("n")))
    weight = F.zip_with("tf", "df", lambda tf, df_: tf / F.col("len") * (F.ln((F.col("n") + 1) / (df_ + 1)) + 1))
    scored = hits.crossJoin(F.broadcast(stats)).withColumn("score", F.aggregate(weight, F.lit(0.0), lambda a, x: a + x))
    if mode == "and":
        scored = scored.filter(F.forall("tf", lambda n: n > 0))
    return scored.select(key, F.round("score", 6).alias("score"))


def phrase_search(docs: DataFrame, phrase: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in which the words stand next to each other."""
    return docs.filter(words_in_row(F.col(text), phrase)).select(key)


# sketches
def minhash(tokens: Column, hashes: int = 64) -> Column:
    """MinHash signature of an array of tokens."""
    return F.array(*[F.array_min(F.transform(tokens, _seeded(i))) for i in range(hashes)])


def _seeded(i: int):
    return lambda t: F.xxhash64(t, F.lit(i))


def signature_similarity(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def minhash_pairs(sets: DataFrame, rows: int = 4) -> DataFrame:
    """id_a, id_b, estimate, exact: the similarity of all pairs of sets (id, w) that agree in a band of ``rows`` values of their signatures (s).

    Sets go to the buckets of bands that they share, so a set moves once for each bucket and not for each
    pair; of buckets with the same members the first is kept, and a pair counts in its first common band only.
    Words move as 64-bit hashes.
    """
    keys = F.transform(F.sequence(F.lit(0), F.size("s") - rows, F.lit(rows)), lambda i: F.xxhash64(F.slice("s", i + 1, rows)))
    member = sets.select("id", F.posexplode(keys).alias("band", "key"))
    buckets = member.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(id))").alias("x")).filter("n > 1")
    first = buckets.groupBy("n", "x").agg(F.min(F.struct("band", "key")).alias("at")).select("at.band", "at.key")
    of = member.join(first, ["band", "key"]).groupBy("id").agg(F.collect_list(F.struct("band", "key")).alias("at"))
    hashed = sets.select("id", "s", keys.alias("k"), F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    placed = hashed.join(of, "id").select("id", "s", "k", "w", F.inline("at"))
    a, b = placed.alias("a"), placed.alias("b")
    once = F.array_position(F.zip_with("a.k", "b.k", lambda x, y: x == y), F.lit(True)) == F.col("a.band") + 1
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).filter(once)
    both = F.size(F.array_intersect("a.w", "b.w"))
    exact = both / (F.size("a.w") + F.size("b.w") - both)
    return pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), signature_similarity(F.col("a.s"), F.col("b.s")).alias("estimate"), exact.alias("exact"))


BLOOM_WORD = 64  # bits of a filter that one row holds
BLOOM_BLOCK = 1024  # words that stand in one array when a filter goes to the tasks


def bloom_position(value: Column, bits: int, i: int) -> Column:
    return F.pmod(F.xxhash64(value, F.lit(i)), F.lit(bits))


def bloom_filter(df: DataFrame, column: str, n: int = 1000, fp: float = 0.01) -> DataFrame:
    """A Bloom filter for ``n`` values with a rate ``fp`` of false hits: word, mask, bits, hashes. Filters of one size merge by OR of their words."""
    bits = max(BLOOM_WORD, math.ceil(-n * math.log(fp) / math.log(2) ** 2))
    hashes = max(1, round(bits / n * math.log(2)))
    at = df.filter(F.col(column).isNotNull()).select(F.explode(F.array(*[bloom_position(F.col(column), bits, i) for i in range(hashes)])).alias("p"))
    words = at.groupBy(F.floor(F.col("p") / BLOOM_WORD).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(BLOOM_WORD)).cast("int"))).alias("mask"))
    return words.withColumn("bits", F.lit(bits)).withColumn("hashes", F.lit(hashes))


def bloom_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("word", "bits", "hashes").agg(F.bit_or("mask").alias("mask")).select("word", "mask", "bits", "hashes")


def might_contain(df: DataFrame, column: str, bloom: DataFrame) -> DataFrame:
    """The rows whose value may be in a filter; none that is in it is lost.

    The filter, of a size fixed when it was made, goes to the tasks once as the value of
    a scalar subquery: an array of blocks of words, so a test looks up each word by its
    place and no row carries the filter. Words without a bit are filled in.
    """
    first = bloom.select("bits", "hashes").first()
    if first is None:
        return df.limit(0)
    bits, hashes = first
    size = -(-bits // (BLOOM_WORD * BLOOM_BLOCK)) * BLOOM_BLOCK
    words = bloom.select("word", "mask").unionByName(df.sparkSession.range(size).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask")))
    words = words.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    listed = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    blocks = words.groupBy(F.floor(F.col("word") / BLOOM_BLOCK).alias("block")).agg(listed("word", "mask").alias("masks"))
    whole = blocks.agg(listed("block", "masks").alias("bloom")).scalar()
    test = F.col(column).isNotNull()
    for i in range(hashes):
        p = bloom_position(F.col(column), bits, i)
        word = whole[F.floor(p / (BLOOM_WORD * BLOOM_BLOCK)).cast("int")][F.pmod(F.floor(p / BLOOM_WORD), F.lit(BLOOM_BLOCK)).cast("int")]
        test = test & (F.call_function("shiftright", word, F.pmod(p, F.lit(BLOOM_WORD)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return df.filter(test)


def count_min(df: DataFrame, column: str, width: int = 1024, depth: int = 5) -> DataFrame:
    """A Count-Min sketch: row, slot, n. Sketches of one size merge by adding."""
    at = df.filter(F.col(column).isNotNull()).select(F.posexplode(F.array(*[F.pmod(F.xxhash64(column, F.lit(i)), F.lit(width)) for i in range(depth)])).alias("row", "slot"))
    return at.groupBy("row", "slot").agg(F.count(F.lit(1)).alias("n"))


def count_min_estimate(sketch: DataFrame, values: DataFrame, column: str, width: int = 1024, depth: int = 5) -> DataFrame:
    """value, estimate: how often each value was seen at most; never too small."""
    at = values.select(F.col(column).alias("value")).distinct().select("value", F.posexplode(F.array(*[F.pmod(F.xxhash64("value", F.lit(i)), F.lit(width)) for i in range(depth)])).alias("row", "slot"))
    return at.join(sketch, ["row", "slot"], "left").groupBy("value").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def equi_height_histogram(df: DataFrame, column: str, buckets: int, accuracy: int = 10000) -> DataFrame:
    """bucket, lo, hi, n: bounds at quantiles, so buckets hold about as many rows; equal values are in one bucket."""
    cuts = df.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], accuracy).alias("cuts"))
    placed = df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(cuts)).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(column))))
    return placed.groupBy("bucket").agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("n"))


def range_estimate(histogram: DataFrame, low: float, high: float) -> DataFrame:
    """estimate: about how many values lie in a range, if values are spread evenly inside each bucket."""
    width = (F.col("hi") - F.col("lo")).cast("double")
    inside = F.least(F.col("hi"), F.lit(high)) - F.greatest(F.col("lo"), F.lit(low))
    share = F.when(inside < 0, 0.0).when(width == 0, 1.0).otherwise(inside / width)
    return histogram.agg(F.coalesce(F.sum(F.col("n") * share), F.lit(0.0)).alias("estimate"))


def matrix_transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matrix_trace(m: DataFrame) -> DataFrame:
    return m.filter("i = j").agg(F.sum("v").alias("trace"))


def stabbed(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs of a point and an interval low <= point <= high, whole numbers: an equi-join on slices of ``width``, so no point meets intervals elsewhere."""
    (slice_,) = unused([*points.columns, *intervals.columns], "slice")
    spread = intervals.withColumn(slice_, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn(slice_, F.floor(F.col(point) / width)).join(spread, slice_).filter(F.col(point).between(F.col(low), F.col(high))).drop(slice_)


def equi_width_histogram(df: DataFrame, column: str, low: float, high: float, buckets: int) -> DataFrame:
    b = F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(buckets).cast("long"))
    return df.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))


# documents
def doc_test(column: str, query: dict) -> Column:
    """Whether a JSON document answers a query of dotted paths with $eq $ne $gt $gte $lt $lte $in $exists.

    Numbers compare as numbers, all else as text, so ISO dates are in order. A
    missing field answers $ne and $exists: false only.
    """
    out = F.lit(True)
    for path, cond in query.items():
        v = F.get_json_object(column, f"$.{path}")
        for op, x in (cond if isinstance(cond, dict) else {"$eq": cond}).items():
            number = isinstance(x, (int, float)) and not isinstance(x, bool)
            c = F.try_variant_get(F.try_parse_json(column), f"$.{path}", "double") if number else v
            x = str(x).lower() if isinstance(x, bool) and op != "$exists" else x
            test = {
                "$eq": lambda: c == x, "$ne": lambda: ~F.coalesce(c == x, F.lit(False)), "$gt": lambda: c > x, "$gte": lambda: c >= x, "$lt": lambda: c < x, "$lte": lambda: c <= x,
                "$in": lambda: v.isin(*[str(y) for y in x]), "$exists": lambda: v.isNotNull() if x else v.isNull(),
            }[op]()
            out = out & F.coalesce(test, F.lit(False))
    return out


def doc_find(df: DataFrame, column: str, query: dict) -> DataFrame:
    """Documents that a query matches; see :func:`doc_test`."""
    return df.filter(doc_test(column, query))


def doc_update(df: DataFrame, column: str, query: dict, change: dict) -> DataFrame:
    """Documents that the query matches with $set, $inc and $unset of dotted paths; all others as they are."""
    match = doc_test(column, query)
    out = F.col(column)
    for path, value in change.get("$set", {}).items():
        out = json_set(out, f"$.{path}", value)
    for path, by in change.get("$inc", {}).items():
        out = json_add(out, f"$.{path}", by)
    for path in change.get("$unset", {}):
        out = json_remove(out, f"$.{path}")
    return df.withColumn(column, F.when(F.coalesce(match, F.lit(False)), out).otherwise(F.col(column)))


def doc_aggregate(df: DataFrame, column: str, pipeline: list[dict]) -> DataFrame:
    """$match, $group with $sum, $count and $avg, $sort and $limit over JSON documents."""
    field = lambda e: F.get_json_object(column, f"$.{e[1:]}") if isinstance(e, str) and e.startswith("$") else F.lit(e)
    out = df
    for stage in pipeline:
        (op, x), = stage.items()
        if op == "$match":
            out = doc_find(out, column, x)
        elif op == "$group":
            aggs = []
            for name, a in x.items():
                if name != "_id":
                    (f, e), = a.items()
                    aggs.append({"$sum": lambda: F.sum(field(e).cast("double")), "$avg": lambda: F.avg(field(e).cast("double")), "$count": lambda: F.count(F.lit(1))}[f]().alias(name))
            out = out.groupBy(field(x["_id"]).alias("_id")).agg(*aggs)
        elif op == "$sort":
            out = out.orderBy(*[F.asc(k) if d > 0 else F.desc(k) for k, d in x.items()])
        else:
            out = out.limit(x)
    return out


# change capture
def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, op: insert, update or delete between two versions of a table, by one full join on a row hash."""
    h = lambda d, n: d.select(key, F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in d.columns]).alias(n))
    both = h(before, "b").join(h(after, "a"), key, "full")
    op = F.when(F.col("b").isNull(), "insert").when(F.col("a").isNull(), "delete").when(F.col("a") != F.col("b"), "update")
    return both.select(key, op.alias("op")).filter(F.col("op").isNotNull())


class ChangeLog:
    """A log of a table's changes with running numbers: capture versions, read from any number on."""

    def __init__(self, key: str):
        self.key, self.last, self.log = key, 0, None

    def capture(self, before: DataFrame, after: DataFrame) -> None:
        """Appends the difference of two versions, in order of the key."""
        diff = with_sequence(snapshot_diff(before, after, self.key), [self.key], "seq", self.last + 1)
        self.log = written(diff if self.log is None else self.log.unionByName(diff))
        self.last = self.log.agg(F.coalesce(F.max("seq"), F.lit(self.last))).first()[0]

    def changes(self, after: int = 0) -> DataFrame:
        """seq, key and op of all changes with a number above ``after``."""
        return self.log.filter(F.col("seq") > after)


class ResultCache:
    """Stored results of aggregations by a name for the query; a table's change forgets those that read it."""

    def __init__(self, most: int = 128):
        self.most, self.kept, self.hits = most, {}, 0

    def get(self, name: str, tables: tuple[str, ...], query) -> DataFrame:
        if name in self.kept:
            self.hits += 1
            return self.kept[name][1]
        if len(self.kept) >= self.most:
            self.kept.pop(next(iter(self.kept)))
        self.kept[name] = (tables, written(query()))
        return self.kept[name][1]

    def changed(self, table: str) -> None:
        self.kept = {k: v for k, v in self.kept.items() if table not in v[0]}
