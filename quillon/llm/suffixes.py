"""Removal of repeated passages with a logarithmic family of suffix arrays.

A repeated string of ``LENGTH`` bytes has the same bytes wherever it stands, so
it picks the same anchors: its positions with the least hash of ``GRAM`` bytes.
Anchors that occur once anywhere are dropped; the suffixes at the others, with
the bytes on both sides of them, are dealt out by anchor and indexed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import bytehash
from quillon.llm.common import broadcast_if_small, materialize, release

LENGTH = 200  # bytes of a string that counts as repeated
GRAM = 50  # bytes of an anchor
LEFT = LENGTH - GRAM  # bytes that such a string can reach before its anchor
BATCH = 8192  # suffixes that enter the family at a time
GROUP = 16384  # suffixes that a task's bucket has on the average
HOT = 100_000  # anchors with more different surroundings are counted by window, in the engine


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of texts that stand one after the other and end at ``ends``.

    Every window of ``length`` bytes inside one text holds the places of its
    least gram hash, all of them in case of ties.
    """
    grams = bytehash.windows(data, gram)
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    end_of = np.repeat(ends, np.diff(ends, prepend=0))
    least = bytehash.sliding_min(grams, length - gram + 1)
    least = np.where(np.arange(n) + length <= end_of[:n], least, np.uint64(0))
    reach = length - gram
    padded = np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)])
    most = ~bytehash.sliding_min(~padded, reach + 1)
    at = np.flatnonzero((most == grams) & (grams > 0))
    return at, grams[at]


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def flush(a: list[int], b: list[int], parts: list[bytes]) -> pd.DataFrame:
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        at, h = anchors(data, ends)
        row = np.searchsorted(ends, at, side="right")
        return pd.DataFrame({"ra": np.array(a)[row], "rb": np.array(b)[row], "hash": h.view(np.int64), "pos": (at - (ends - sizes)[row]).astype(np.int32)})

    a, b, parts, held = [], [], [], 0
    for batch in batches:
        for ra, rb, t in zip(batch["ra"], batch["rb"], batch["t"]):
            if t is None or len(t) < LENGTH:
                continue
            a.append(ra), b.append(rb), parts.append(bytes(t))
            held += len(t)
            if held > 1 << 18:
                yield flush(a, b, parts)
                a, b, parts, held = [], [], [], 0
    if parts:
        yield flush(a, b, parts)


def shared(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For pairs of rows, the bytes after the head that they share before a text ends or they differ; -1 for another anchor."""
    differ = (rows != others) | (rows == 0)
    body = differ[:, 9:]
    lcp = np.where(body.any(axis=1), body.argmax(axis=1), body.shape[1])
    return np.where(differ[:, :8].any(axis=1) & (rows[:, :8] != others[:, :8]).any(axis=1), -1, lcp)


@dataclass(frozen=True)
class Array:
    """A suffix array: rows in order, whose they are, and what each but the first shares with the one before."""

    rows: np.ndarray
    at: np.ndarray
    lcp: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Array:
        order = np.argsort(Array.view(rows), kind="stable")
        rows = rows[order]
        return Array(rows, order, shared(rows[1:], rows[:-1]))

    @staticmethod
    def view(rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()

    def merged(self, other: Array) -> Array:
        """Both in one order; neighbours that stay neighbours keep what they share. The other's rows get the numbers after this one's."""
        n, m = len(self.at), len(other.at)
        behind = np.searchsorted(self.view(self.rows), self.view(other.rows), side="right") + np.arange(m)
        theirs = np.zeros(n + m, bool)
        theirs[behind] = True
        ahead = np.flatnonzero(~theirs)
        rows = np.empty((n + m, self.rows.shape[1]), np.uint8)
        rows[ahead], rows[behind] = self.rows, other.rows
        at, lcp = np.empty(n + m, np.int64), np.empty(n + m, np.int64)
        at[ahead], at[behind] = self.at, other.at + n
        lcp[ahead[1:]], lcp[behind[1:]] = self.lcp, other.lcp
        new = np.flatnonzero(theirs[1:] != theirs[:-1]) + 1
        lcp[new] = shared(rows[new], rows[new - 1])
        return Array(rows, at, lcp[1:])


@dataclass(frozen=True)
class Level:
    """Suffix arrays of anchors' surroundings: forwards from the anchor, and backwards from it."""

    ids: np.ndarray
    forward: Array
    backward: Array

    @staticmethod
    def of(ids: np.ndarray, hashes: np.ndarray, lefts: list[bytes], rights: list[bytes]) -> Level:
        """Rows of bytes, zero where a text ends; the first nine of each name the anchor, and no other byte is zero."""
        head = hashes.astype(">i8").view(np.uint8).reshape(-1, 8)

        def rows(texts: list[bytes], size: int, back: bool) -> np.ndarray:
            out = np.zeros((len(texts), 9 + size), np.uint8)
            out[:, :8], out[:, 8] = head, 1
            for i, t in enumerate(texts):
                x = np.frombuffer(t, np.uint8)
                out[i, 9 : 9 + len(x)] = (x[::-1] if back else x) + 1  # UTF-8 has no byte 255
            return out

        return Level(ids, Array.of(rows(rights, LENGTH, False)), Array.of(rows(lefts, LEFT, True)))

    def __len__(self) -> int:
        return len(self.ids)

    def merged(self, other: Level) -> Level:
        return Level(np.concatenate([self.ids, other.ids]), self.forward.merged(other.forward), self.backward.merged(other.backward))


def repeated(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of a level, the largest and the least number of bytes before the anchor of a repeated window; -1 without one.

    Windows that begin ``l`` bytes before their anchors are equal if the suffixes
    share ``LENGTH - l`` bytes forwards and ``l`` bytes backwards: if they lie in
    the same run of both sorted orders, cut where neighbours share less.
    """
    n = len(level)
    most, least = np.full(n, -1), np.full(n, -1)
    if n < 2:
        return most, least
    f, b = level.forward, level.backward
    fr, br = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for l in range(LEFT + 1):
        fr[f.at[1:]] = np.cumsum(f.lcp < LENGTH - l)
        fr[f.at[0]] = 0
        br[b.at[1:]] = np.cumsum(b.lcp < l)
        br[b.at[0]] = 0
        key = fr * n + br
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        hit = np.zeros(n, bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        most[hit] = l
        least[hit & (least < 0)] = l
    return most, least


class Family:
    """Suffix arrays of growing size. A new batch is merge-scanned against each of them; then arrays of like size merge."""

    def __init__(self) -> None:
        self.levels: list[Level] = []
        self.most: dict[int, int] = {}
        self.least: dict[int, int] = {}

    def _note(self, level: Level) -> None:
        most, least = repeated(level)
        for k in np.flatnonzero(most >= 0):
            i = int(level.ids[k])
            self.most[i] = max(self.most.get(i, -1), int(most[k]))
            self.least[i] = min(self.least.get(i, LENGTH), int(least[k]))

    def add(self, batch: Level) -> None:
        if not self.levels:
            self._note(batch)
        both = [level.merged(batch) for level in self.levels]
        for x in both:
            self._note(x)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            last = self.levels.pop()
            # The last level and the batch have been merged for the scan.
            self.levels[-1] = both[-1] if last is batch else self.levels[-1].merged(last)


def _scan_bucket(group: pd.DataFrame) -> pd.DataFrame:
    """Matches among the surroundings of one bucket: for each with a repeated window, how far it reaches to both sides."""
    group = group.sort_values("hash", kind="stable").reset_index(drop=True)
    family = Family()
    hashes = group["hash"].to_numpy(np.int64)
    lefts, rights = [bytes(x) for x in group["left"]], [bytes(x) for x in group["right"]]
    for i in range(0, len(group), BATCH):
        j = min(i + BATCH, len(group))
        family.add(Level.of(np.arange(i, j), hashes[i:j], lefts[i:j], rights[i:j]))
    at = sorted(family.most)
    return pd.DataFrame(
        {
            "hash": hashes[at],
            "ca": group["ca"].to_numpy(np.int64)[at],
            "cb": group["cb"].to_numpy(np.int64)[at],
            "lo": np.array([-family.most[i] for i in at], np.int64),
            "hi": np.array([LENGTH - family.least[i] for i in at], np.int64),
        }
    )


def hot_windows(contexts: DataFrame) -> DataFrame:
    """The same as :func:`_scan_bucket`, by counting all windows; for anchors too common for one bucket."""
    whole = F.concat("left", "right")
    l = F.explode(F.sequence(F.greatest(F.lit(0), LENGTH - F.octet_length("right")), F.least(F.octet_length("left"), F.lit(LEFT)))).alias("l")
    fits = contexts.filter(F.octet_length("left") + F.octet_length("right") >= LENGTH)
    w = fits.select("hash", "ca", "cb", whole.alias("b"), F.octet_length("left").alias("n"), l)
    piece = F.substring(F.col("b"), F.col("n") - F.col("l") + 1, F.lit(LENGTH))
    w = w.select("hash", "ca", "cb", "l", F.xxhash64(piece).alias("wa"), F.xxhash64(piece, F.lit(2)).alias("wb"))
    twice = w.groupBy("wa", "wb").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("wa", "wb")
    return w.join(twice, ["wa", "wb"], "left_semi").groupBy("hash", "ca", "cb").agg((-F.max("l")).cast("long").alias("lo"), (LENGTH - F.min("l")).cast("long").alias("hi"))


def row_key(key: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, text).alias("ra"), F.xxhash64(text, key, F.lit("b")).alias("rb")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """ra, rb, start, end: the byte ranges of ``docs`` (ra, rb, t) that repeated strings cover; ranges may overlap."""
    found = materialize(docs.mapInPandas(_anchor_rows, "ra long, rb long, hash long, pos int"), "suffix-anchors")
    # Stored, so that the join has a plain scan on this side and Spark may split a hot anchor's rows on the other.
    twice = materialize(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "suffix-twice")
    shared = found.join(twice, "hash", "left_semi")
    lists = shared.groupBy("ra", "rb").agg(F.collect_set(F.struct("hash", "pos")).alias("at"))
    copies = docs.groupBy("ra", "rb").agg(F.count(F.lit(1)).alias("copies"), F.first("t").alias("t"))
    occ = copies.join(lists, ["ra", "rb"]).select("ra", "rb", "copies", "t", F.explode("at").alias("x"))
    p = F.col("x.pos")
    left = F.substring(F.col("t"), F.greatest(F.lit(0), p - LEFT) + 1, F.least(p, F.lit(LEFT)))
    occ = occ.select("ra", "rb", "copies", "x.hash", p.alias("pos"), left.alias("left"), F.substring(F.col("t"), p + 1, F.lit(LENGTH)).alias("right"))
    occ = occ.withColumn("ca", F.xxhash64("left", "right")).withColumn("cb", F.xxhash64("right", "left", F.lit("b")))
    occ = materialize(occ, "suffix-contexts")
    release(found, twice)
    # Equal surroundings come together first, on the map side already, so an anchor has no more rows below than it has different ones.
    counts = occ.groupBy("hash", "ca", "cb").agg(F.sum("copies").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    counts = materialize(counts, "suffix-counts")
    nl, nr = F.octet_length("left"), F.octet_length("right")
    whole = counts.filter((F.col("n") > 1) & (nl + nr >= LENGTH)).select("hash", "ca", "cb", (-nl).cast("long").alias("lo"), nr.cast("long").alias("hi"))
    open_ = counts.groupBy("hash").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("k > 1 and least = 1").select("hash", "k")
    open_ = materialize(open_, "suffix-open")
    total = open_.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // GROUP))
    surround = counts.select("hash", "ca", "cb", "left", "right").join(broadcast_if_small(open_), "hash")
    dealt = surround.filter(F.col("k") <= HOT).withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    scanned = dealt.groupBy("bucket").applyInPandas(_scan_bucket, "hash long, ca long, cb long, lo long, hi long")
    parts = [whole, scanned]
    if open_.filter(F.col("k") > HOT).limit(1).count():
        parts.append(hot_windows(surround.filter(F.col("k") > HOT)))
    spans = parts[0]
    for x in parts[1:]:
        spans = spans.unionByName(x)
    # Stored, so that the join has plain scans on both sides and Spark may split a surrounding that stands in very many places.
    spans = materialize(spans.groupBy("hash", "ca", "cb").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "suffix-spans")
    placed = occ.select("ra", "rb", "hash", "pos", "ca", "cb").join(spans, ["hash", "ca", "cb"])
    placed = materialize(placed.select("ra", "rb", "pos", "lo", "hi"), "suffix-ranges")
    release(occ, counts, open_, spans)
    return placed.select("ra", "rb", (F.col("pos") + F.col("lo")).cast("int").alias("start"), (F.col("pos") + F.col("hi")).cast("int").alias("end"))


def covered(size: int, ranges: list | None) -> np.ndarray:
    """A flag for each byte that a range covers."""
    step = np.zeros(size + 1, np.int32)
    if ranges is not None and len(ranges):
        at = np.array([(r["start"], r["end"]) for r in ranges])
        np.add.at(step, at[:, 0], 1)
        np.add.at(step, at[:, 1], -1)
    return np.cumsum(step)[:size] > 0


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for t, ranges in zip(batch["t"], batch["ranges"]):
            data = np.frombuffer(bytes(t), np.uint8)
            gone = covered(len(data), ranges)
            starts = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0])))
            rows.append((len(data), int(gone.sum()), starts, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        yield pd.concat([batch[["doc_id"]].reset_index(drop=True), out], axis=1)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, t as UTF-8 and the 128-bit key of both, ra and rb."""
    d = docs.select(F.col(key).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("t"))
    return d.select("doc_id", *row_key(F.col("doc_id"), F.col("t")), "t")


def cut(d: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each row of ``d`` (doc_id, ra, rb, t) without the ranges (ra, rb, start, end)."""
    ranges = materialize(ranges.groupBy("ra", "rb").agg(F.collect_set(F.struct("start", "end")).alias("ranges")), "suffix-cuts")
    joined = d.join(ranges, ["ra", "rb"], "left").select("doc_id", "t", "ranges")
    kind = d.schema["doc_id"].dataType.simpleString()
    return joined.mapInPandas(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: bytes, bytes removed, runs removed, and the digest of what is kept.

    A byte goes if any string of 200 bytes that covers it starts anywhere else
    too, in another document or the same one. Null texts are empty; they and
    texts under 200 bytes keep everything. Rows with the same key, null keys too,
    are documents of their own, and equal rows repeat each other. Other columns,
    whatever their names, are ignored; an empty table gives an empty result.
    """
    d = keyed(docs, key, text)
    return cut(d, repeated_ranges(d.select("ra", "rb", "t")))


class Index:
    """A logarithmic family of document tables in the shared folder, to which batches are added.

    A level holds the texts of some batches and the places of their anchors. A new
    batch is scanned against itself and then against each level: only documents of
    the level that share an anchor with the batch are read again. Then the batch
    becomes a level, and the last two levels merge while they are of like size, so
    there are about as many levels as the logarithm of the batches.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[DataFrame, DataFrame, int]] = []  # texts, anchors, rows

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The same as :func:`remove_repeats` gives for these documents, judged together with all that were added before."""
        d = materialize(keyed(docs, key, text), "suffix-batch")
        texts = d.select("ra", "rb", "t")
        places = materialize(texts.mapInPandas(_anchor_rows, "ra long, rb long, hash long, pos int").select("ra", "rb", "hash").distinct(), "suffix-places")
        ranges = repeated_ranges(texts)
        for old, at, _ in self.levels:
            near = at.join(places.select("hash").distinct(), "hash", "left_semi").select("ra", "rb").distinct()
            ranges = ranges.unionByName(repeated_ranges(texts.unionByName(old.join(near, ["ra", "rb"], "left_semi"))))
        out = materialize(cut(d, ranges.join(texts.select("ra", "rb").distinct(), ["ra", "rb"], "left_semi")), "suffix-kept")
        self.levels.append((texts, places, texts.count()))
        while len(self.levels) > 1 and self.levels[-2][2] <= 2 * self.levels[-1][2]:
            (t, p, n), (u, q, m) = self.levels.pop(-2), self.levels.pop()
            self.levels.append((materialize(t.unionByName(u), "suffix-level"), materialize(p.unionByName(q), "suffix-places"), n + m))
        return out
