"""Removal of lines that are spread over many sites, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACES, broadcast_if_small, fresh, materialize, packed, release

MIN_SITES = 10  # a line on so many sites is boilerplate
LG_K = 10  # sketch of 2**LG_K buckets: a standard error of about 3 %
MARGIN = 0.2  # estimates within this share of the threshold get an exact count
MOST_PLACES = 4_000_000  # numbers and characters, some 32 MB, of rows and places that go to the texts by broadcast; more join by a shuffle


def line_key(line: Column) -> Column:
    """128 bits of the trimmed line; the two halves come from independent hashes."""
    t = F.btrim(line, F.lit(SPACES))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(t, F.lit("second")).alias("b"))


def exploded(docs: DataFrame) -> DataFrame:
    """One row for each line with a word: key of the row, n (its place), site, key."""
    lines = docs.select("id", F.coalesce("site", F.lit("")).alias("site"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line"))
    return lines.filter(F.length(F.translate("line", SPACES, "")) > 0).select("id", "n", "site", line_key(F.col("line")).alias("key"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """Keys of the lines on ``min_sites`` sites or more, each with the place that keeps the line.

    A first count by key drops lines with fewer than ``min_sites`` occurrences;
    they can't be on so many sites. For the rest, one HyperLogLog sketch a key is
    built on each side of the shuffle and merged. Estimates far from the
    threshold decide at once; near ones are counted exactly. All aggregations
    combine on the map side, so a line that a third of all rows hold comes as
    one sketch from each task. Keys go to the lines by broadcast if they are few.
    """
    often = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("key")
    often = materialize(often, "line-keys")
    seen = lines.join(broadcast_if_small(often), "key", "left_semi")
    sketched = seen.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"),
        F.min(F.struct("id", "n")).alias("first"),
    )
    sketched = materialize(sketched.filter(F.col("sites") >= min_sites * (1 - margin)), "line-sketches")
    sure = sketched.filter(F.col("sites") > min_sites * (1 + margin)).select("key", "first")
    near = sketched.filter(F.col("sites") <= min_sites * (1 + margin))
    counted = (
        lines.join(broadcast_if_small(near.select("key")), "key", "left_semi")
        .select("key", "site")
        .distinct()
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("exact"))
        .filter(F.col("exact") >= min_sites)
        .select("key")
    )
    return sure.unionByName(near.select("key", "first").join(counted, "key", "left_semi"))


def removed_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """For the key of each row with a boilerplate line, the sorted places of the lines to remove.

    Texts are split once; the keys of their lines are stored. The places go to the
    texts by broadcast where they are few by count, else by a shuffle.
    """
    lines = materialize(exploded(docs), "lines")
    found = broadcast_if_small(materialize(boilerplate(lines, min_sites), "line-boilerplate"))
    gone = lines.join(found, "key").filter((F.col("id") != F.col("first.id")) | (F.col("n") != F.col("first.n")))
    gone = materialize(gone.groupBy("id").agg(F.array_sort(F.collect_set("n")).alias("gone")), "line-places")
    release(lines)
    places = gone.agg(F.coalesce(F.sum(F.size("gone") + F.length("id.s") + 1), F.lit(0))).first()[0]
    return F.broadcast(gone) if places <= MOST_PLACES else gone.hint("merge")


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", key: str = "doc_id") -> DataFrame:
    """``row`` with the whole row, and clean_text, n_lines and n_removed; see :func:`dedup_lines`."""
    keyed = docs.select(packed(docs).alias("row"), F.col(text).alias("text"), F.col(site).cast("string").alias("site"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("s"), F.xxhash64(text, site).alias("h"))
    keyed = keyed.withColumn("id", F.struct(F.length("s").alias("len"), "s", "h")).drop("s", "h")
    gone = removed_lines(keyed.select("id", "text", "site"), min_sites)
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return keyed.join(gone, "id", "left").select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("clean_text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", key: str = "doc_id") -> DataFrame:
    """Adds ``clean_text``, ``n_lines`` and ``n_removed`` to every row.

    A line (trimmed) on ``min_sites`` different sites or more stays only in its
    first place, that of the smallest key (null before all) and line number, and goes everywhere
    else, in the rest of the same text too. Other lines stay as they are. Lines
    without a word are never removed. A null text stays null with no lines; a null
    site counts as one site; rows that share a key, null included, share the
    places removed only if their texts are equal, since the row key also holds
    a hash of the text. Of fully equal rows, each keeps what the first keeps.
    Columns of the input stay as they are; where one has the name of a new
    column, the new one gets an underscore. An empty table stays empty.
    """
    names = ("clean_text", "n_lines", "n_removed")
    new = zip(names, fresh(docs.columns, *names))
    return cleaned(docs, min_sites, text, site, key).select("row.*", *[F.col(a).alias(b) for a, b in new])
