"""Mixing sources to target weights by a multivariate hypergeometric splitting tree, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillon.llm.common import WORD, let, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix for each word of the input
MAX_REPEAT = 2.0  # a target is at most so many times its source's size
BLOCK_WORDS = 65536  # a source has a block for so many words,
MIN_BLOCKS = 16  # at least so many,
MAX_BLOCKS = 4096  # and at most so many, which then grow
LEVELS = 3  # the tree has 2**LEVELS output shards


def hash60(*parts: Column) -> Column:
    """A whole number under 2**60 from the MD5 of the parts, which other SQL engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """key, source, size in words, and ``h``, the place in the source's random order."""
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    h = hash60(F.lit("mix"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n.alias("size"), h.alias("h"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Adds ``target`` to one row for each source with its ``source_size``.

    Sources by code point, null last, take the weights in turn. The level of
    water filling is a fixpoint: sources above their cap get the cap, the rest
    share what remains by weight, until none is above. Each round is one small
    aggregation; at most as many rounds as sources are needed, in practice a few.
    """
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    # The number of sources bounds this window; it is one row a source.
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", pick.cast("double"))
    ranked = materialize(ranked.withColumn("cap", F.col("source_size") * F.lit(max_repeat)), "mix-sources")
    total = float(share) * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        kept, weight = ranked.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        new = (total - kept) / weight if weight else level
        if new <= level or not weight:
            break
        level = new
    return ranked.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).drop("cap")


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """A draw, for the uniform ``u``, of how many of ``drawn`` items are marked.

    Inverts the distribution over its mean and 12 standard deviations each way,
    outside of which double precision has no mass left. Log weights follow from
    one another by the ratio of neighbours, so no factorial is needed.
    """
    n, k, m = population.cast("double"), marked.cast("double"), drawn.cast("double")
    mean = m * k / F.greatest(n, F.lit(1.0))
    sd = F.sqrt(F.greatest(mean * (n - k) * (n - m) / F.greatest(n * F.greatest(n - 1, F.lit(1.0)), F.lit(1.0)), F.lit(0.0)))
    low = F.greatest(F.lit(0.0), m - (n - k), F.floor(mean - 12 * sd) - 2).cast("long")
    high = F.least(F.least(k, m), F.ceil(mean + 12 * sd) + 2).cast("long")

    def logs(x0: Column, x1: Column) -> Column:
        first = F.array(F.struct(x0.alias("x"), F.lit(0.0).alias("l")))

        def grow(acc: Column, x: Column) -> Column:
            at = (x - 1).cast("double")
            ratio = (k - at) * (m - at) / ((at + 1) * (n - k - m + at + 1))
            last = F.element_at(acc, -1)["l"]
            return F.array_append(acc, F.struct(x.alias("x"), (last + F.ln(ratio)).alias("l")))

        return F.aggregate(F.filter(F.sequence(x0, x1), lambda x: x > x0), first, grow)

    def invert(rows: Column) -> Column:
        top = F.array_max(F.transform(rows, lambda r: r["l"]))
        total = F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.exp(r["l"] - top))
        picked = F.aggregate(
            rows,
            F.struct(F.lit(0.0).alias("sum"), rows[0]["x"].alias("x")),
            lambda a, r: F.struct(
                (a["sum"] + F.exp(r["l"] - top)).alias("sum"),
                F.when(a["sum"] < u * total, r["x"]).otherwise(a["x"]).alias("x"),
            ),
        )
        return picked["x"]

    return let(F.struct(low.alias("a"), F.greatest(low, high).alias("b")), lambda s: let(logs(s["a"], s["b"]), invert))


def split_quotas(sources: DataFrame, levels: int = LEVELS, seed: str = "tree") -> DataFrame:
    """Splits each source's block draws (``draws``) among ``2**levels`` shards; returns rank, shard, first, last.

    A node holds a quota for each source and halves its draws: source by source,
    the left child takes a hypergeometric number of them, given what the sources
    before it took, so both children have exact quotas and every shard gets the
    same number of blocks, or one more or less. ``first`` and ``last`` (exclusive)
    are the shard's draws in the source's random order; shards never overlap.
    A node is one row with an array as long as there are sources.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), F.col("draws").cast("long").alias("draws"))))
    nodes = sources.agg(rows.alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["draws"])
        u = lambda x, lv=level: F.pmod(F.xxhash64(F.lit(seed), F.lit(lv), F.col("node"), x["rank"]), F.lit(2**40)) / F.lit(float(2**40))
        nodes = nodes.withColumn("total", total)

        def step(acc: Column, x: Column) -> Column:
            took = hypergeometric(acc["n"], x["draws"], acc["m"], u(x))
            return F.struct(
                (acc["n"] - x["draws"]).alias("n"),
                (acc["m"] - took).alias("m"),
                F.array_append(acc["out"], F.struct(x["rank"].alias("rank"), took.alias("draws"))).alias("out"),
            )

        empty = F.from_json(F.lit("[]"), "array<struct<rank:bigint,draws:bigint>>")
        start = F.struct(F.col("total").alias("n"), F.floor((F.col("total") + F.col("node") % 2) / 2).alias("m"), empty.alias("out"))
        left = F.aggregate("q", start, step, lambda a: a["out"])
        nodes = nodes.withColumn("left", left)
        right = F.transform("q", lambda x, i: F.struct(x["rank"].alias("rank"), (x["draws"] - F.get(F.col("left"), i)["draws"]).alias("draws")))
        both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))
        nodes = materialize(nodes.select(F.explode(both).alias("c")).select("c.node", "c.q"), f"mix-level{level}")
    leaves = nodes.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("shard", "x.rank", "x.draws")
    ahead = W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("draws").over(ahead), F.lit(0))).withColumn("last", F.col("first") + F.col("draws")).drop("draws")


def block_count(source_size: Column) -> Column:
    return F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(MIN_BLOCKS), F.ceil(source_size / F.lit(BLOCK_WORDS)))).cast("long")


def draw_blocks(blocks: DataFrame, levels: int) -> DataFrame:
    """rank, block, edge and ``draws``, the passes over each block that the mix makes, each with its shard.

    ``blocks`` has rank, block, words, source_size and goal. A source's blocks
    stand in random order; pass after pass over them is one line of draws that
    ends at the goal. The splitting tree says how many of them each shard gets,
    and each shard takes the next ones of the line, so draws are disjoint. The
    draw in which the goal lies is the source's edge and is cut there.
    """
    before = W.partitionBy("rank").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    b = blocks.filter((F.col("words") > 0) & (F.col("goal") > 0)).withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    epochs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("goal") - 1) / F.col("source_size")).cast("long"))
    b = b.withColumn("epoch", F.explode(epochs)).withColumn("left", F.col("goal") - F.col("epoch") * F.col("source_size") - F.col("start"))
    b = b.filter(F.col("left") > 0).withColumn("draw", F.row_number().over(W.partitionBy("rank").orderBy("epoch", "block")) - 1)
    b = materialize(b.select("rank", "block", "epoch", "draw", F.least("left", "words").alias("words"), (F.col("left") < F.col("words")).alias("cut")), "mix-draws")
    quotas = split_quotas(b.groupBy("rank").agg(F.count(F.lit(1)).alias("draws")), levels)
    at = b.join(quotas, "rank").filter((F.col("draw") >= F.col("first")) & (F.col("draw") < F.col("last")))
    use = F.struct("epoch", "shard", "words", "cut")
    return at.groupBy("rank", "block").agg(F.array_sort(F.collect_list(use)).alias("draws"), F.max("cut").alias("edge"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT, levels: int = LEVELS, **columns: str) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken and ``uses``.

    ``uses`` has an entry for each pass over the document's block: epoch, shard,
    words taken from the document, and its place in the shard, which is the local
    shuffle. Every pass gives a document its size, but in the block where the
    source's target (in whole words) lies documents come by hash order and the
    last one in part, so that a source's words are its target exactly. A null
    text or one without words has size 0 and is taken 0 times; a null source is a
    source, the last; a null key is a key. Repeated rows are taken one by one. An
    empty table gives an empty result. Nothing depends on the order of rows.
    """
    d = materialize(sized(docs, **columns), "mix-sizes")
    sources = d.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    wanted = materialize(targets(sources, weights, share, max_repeat).withColumnRenamed("source", "__source"), "mix-targets")
    dealt = d.join(wanted, d["source"].eqNullSafe(wanted["__source"])).withColumn("block", F.col("h") % block_count(F.col("source_size")))
    blocks = dealt.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first(F.round("target").cast("long")).alias("goal"))
    drawn = materialize(draw_blocks(blocks, levels), "mix-blocks")
    joined = dealt.join(drawn, ["rank", "block"], "left")
    upto = W.partitionBy("rank", "block").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    edge = joined.filter(F.col("edge")).withColumn("__before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    rest = joined.filter(~F.coalesce("edge", F.lit(False))).withColumn("__before", F.lit(0).cast("long"))

    def use(x: Column) -> Column:
        part = F.least(F.col("size"), F.greatest(F.lit(0), x["words"] - F.col("__before")))
        return F.struct(
            x["epoch"].alias("epoch"),
            x["shard"].alias("shard"),
            F.xxhash64(F.lit("place"), F.col("doc_id"), x["epoch"]).alias("place"),
            F.when(x["cut"], part).otherwise(F.col("size")).cast("long").alias("words"),
        )

    both = edge.unionByName(rest)
    both = both.withColumn("uses", F.filter(F.transform(F.coalesce("draws", F.array().cast(drawn.schema["draws"].dataType)), use), lambda x: x["words"] > 0))
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return both.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "uses")


def mixture(docs: DataFrame, levels: int = LEVELS, **columns: str) -> DataFrame:
    """The mix as a dataset: a row for each use of a document, with shard, place in the shard and words."""
    use = mix(docs, levels=levels, **columns).select("doc_id", "source", F.explode("uses").alias("u"))
    return use.select("doc_id", "source", "u.shard", "u.place", "u.epoch", "u.words")
