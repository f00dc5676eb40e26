"""N-gram Jaccard self-join by the size-aware heavy-light method."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bytehash
from quillon.llm.common import SPACES, broadcast_if_small, materialize, packed, release
from quillon.llm.graph import components

SLOT_BITS = 28  # counting slots of a bucket, as a power of two
BUCKET = 1 << 21  # shingles that a counting bucket has on the average
FREQUENT = 32  # shingles in more sets come last in the order
MAX_FREQUENT = 1 << 21  # entries of the table of them that tasks get; above, FREQUENT doubles
MAX_SMALL = 19  # sets beyond this size have too many subsets in any case
LIST = 50_000  # an inverted list is scanned in blocks of so many entries
LEAST_BITS, MOST_BITS = 128, 8192  # of a set's parity sketch; above, sketches only prune less


@dataclass(frozen=True)
class Join:
    """What links two sets: ``den * intersection >= num * union`` over shingles of ``size`` words."""

    size: int = 4
    num: int = 85
    den: int = 100

    def overlap(self, a: int, b: int) -> int:
        """The least intersection of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        """Of two linked sets, the first so many elements in any common order share one."""
        return n - -(-self.num * n // self.den) + 1

    def most_apart(self, total: np.ndarray) -> np.ndarray:
        """Of linked sets with so many elements in all, the most that stand in one of the two only."""
        return total * (self.den - self.num) // (self.den + self.num)

    def partners(self, n: int) -> range:
        """Sizes of sets that a set of ``n`` can link with."""
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)


def shingle_sets(texts: Iterable[str | None], size: int, chunk: int = 1 << 18) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; ASCII letters in lower case; none without words.

    Texts of about ``chunk`` bytes are hashed at once, as one array; a longer text is one of its own.
    """
    gap = np.full(1, 32, np.uint8)

    def sets(parts: list[np.ndarray]) -> Iterator[np.ndarray]:
        data = bytehash.LOWER[np.concatenate(parts)]
        start, end = bytehash.word_bounds(data)
        h = bytehash.between(bytehash.prefix(data), start, end)
        cut = np.searchsorted(start, np.cumsum([0, *(len(p) for p in parts)]))
        whole = bytehash.shingles(h, size) if len(h) >= size else h[:0]
        for a, b in zip(cut.tolist(), cut[1:].tolist()):
            if b - a < size:
                yield bytehash.shingles(h[a:b], size)
                continue
            s = np.sort(whole[a : b - size + 1])
            fresh = np.empty(len(s), bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            yield s[fresh]

    parts, held = [], 0
    for t in texts:
        parts.append(np.concatenate([bytehash.as_bytes(t), gap]))
        held += len(parts[-1])
        if held > chunk:
            yield from sets(parts)
            parts, held = [], 0
    if parts:
        yield from sets(parts)


def _signatures(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, a, b = [], [], []
            for s in shingle_sets(batch["t"], size):
                n.append(len(s))
                a.append(s.sum(dtype=np.uint64))
                b.append(bytehash.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
            yield batch[["doc_id", "ra", "rb"]].assign(n=n, ka=np.array(a, np.uint64).view(np.int64), kb=np.array(b, np.uint64).view(np.int64))

    return run


def pack(slots: np.ndarray) -> bytes:
    """Sorted slots of a bucket as two-byte steps; 65535 means that much and the next step too."""
    step = np.diff(slots, prepend=slots.dtype.type(0))
    more, last = step // 65535, step % 65535
    out = np.full(len(slots) + int(more.sum()), 65535, np.uint16)
    out[np.cumsum(more + 1) - 1] = last
    return out.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    step = np.frombuffer(blob, np.uint16).astype(np.uint64)
    return np.cumsum(step)[step != 65535]


def _count_rows(size: int, bits: int):
    """Shingles of many sets as packed slots by bucket; one set of rows for some million shingles.

    Of each set of rows a slot counts FREQUENT + 1 times at most, so the counts
    of common shingles and the expected list length come out too small. They
    decide the order and the boundary only, of which any is valid.
    """
    shift, limit = np.uint64(64 - SLOT_BITS - bits), 1 << 22

    def flush(parts: list[np.ndarray]) -> pd.DataFrame:
        slots, counts = np.unique(np.concatenate(parts) >> shift, return_counts=True)
        slots = np.repeat(slots, np.minimum(counts, FREQUENT + 1))
        cut = np.searchsorted(slots, np.arange(1 << bits, dtype=np.uint64) << np.uint64(SLOT_BITS))
        blobs = [pack(x & np.uint64((1 << SLOT_BITS) - 1)) for x in np.split(slots, cut[1:])]
        return pd.DataFrame({"bucket": np.arange(1 << bits), "slots": blobs})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            for s in shingle_sets(batch["t"], size):
                parts.append(s)
                held += len(s)
                if held > limit:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _count_bucket(group: pd.DataFrame) -> pd.DataFrame:
    """Slots of a bucket that come more than FREQUENT times, and in a row with slot -1 the sums of counts and of their squares."""
    slots, counts = np.unique(np.concatenate([unpack(x) for x in group["slots"]]), return_counts=True)
    often = counts > FREQUENT
    base = int(group["bucket"].iloc[0]) << SLOT_BITS
    rows = pd.DataFrame({"slot": slots[often].astype(np.int64) + base, "n": counts[often].astype(float), "n2": 0.0})
    return pd.concat([rows, pd.DataFrame({"slot": [-1], "n": [float(counts.sum())], "n2": [float((counts.astype(float) ** 2).sum())]})])


@dataclass(frozen=True)
class Order:
    """A total order of shingles: those not frequent by hash, then the frequent ones from rare to common."""

    shift: int
    slots: np.ndarray
    counts: np.ndarray

    def arrange(self, s: np.ndarray) -> np.ndarray:
        if not len(self.slots):
            return s
        slot = s >> np.uint64(self.shift)
        at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
        count = np.where(self.slots[at] == slot, self.counts[at], 0)
        return s[np.lexsort((s, count))] if count.any() else s


def frequency_order(sets: DataFrame, total: int, size: int) -> tuple[Order, float]:
    """The order, from counts over all sets, and the expected length of a shingle's inverted list.

    The table of frequent shingles goes to every task, so its size is bounded:
    the threshold doubles until it fits. Any threshold gives a valid order.
    """
    bits = max(0, math.ceil(math.log2(max(1, total / BUCKET))))
    rows = sets.select("t").mapInPandas(_count_rows(size, bits), "bucket long, slots binary")
    found = materialize(rows.groupBy("bucket").applyInPandas(_count_bucket, "slot long, n double, n2 double"), "shingle-counts")
    n, n2 = found.filter("slot < 0").agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("n2"), F.lit(0.0))).first()
    often, least = found.filter("slot >= 0"), FREQUENT
    while often.filter(F.col("n") > least).count() > MAX_FREQUENT:
        least *= 2
    table = often.filter(F.col("n") > least).select("slot", F.col("n").cast("long").alias("n")).toPandas().sort_values("slot")
    return Order(64 - SLOT_BITS - bits, table["slot"].to_numpy(np.uint64), table["n"].to_numpy(np.int64)), n2 / n if n else 1.0


def subset_sizes(join: Join, n: int, boundary: int) -> list[int]:
    """Sizes of the subsets that a small set of ``n`` shares with each small set that it links with."""
    return sorted({join.overlap(n, m) for m in join.partners(n) if 1 <= m <= boundary and join.overlap(n, m) <= min(n, m)})


def choose_boundary(join: Join, list_length: float) -> int:
    """Largest size up to which enumerating subsets costs no more than scanning the lists of a set's prefix."""
    best = 0
    for n in range(1, MAX_SMALL + 1):
        if sum(math.comb(n, c) for c in subset_sizes(join, n, n)) > max(1.0, join.prefix(n) * list_length):
            break
        best = n
    return best


def subset_keys(s: np.ndarray, c: int) -> np.ndarray:
    """A hash for each subset of ``c`` elements."""
    spread = bytehash.mix(s ^ np.uint64(0x2545F4914F6CDD1D))
    away = np.array(list(itertools.combinations(range(len(s)), len(s) - c)), np.int64).reshape(math.comb(len(s), c), len(s) - c)
    return bytehash.mix(spread.sum(dtype=np.uint64) - spread[away].sum(axis=1, dtype=np.uint64) + np.uint64(c))


def parities(s: np.ndarray) -> np.ndarray:
    """A set's sketch: for each of two to four times as many slots as it has elements, whether an odd number of them falls there.

    Two sketches differ in no more slots than the sets differ in elements.
    The number of slots is a power of two; half of it is the two halves' XOR.
    """
    slots = min(MOST_BITS, max(LEAST_BITS, 2 << (len(s) - 1).bit_length()))
    spread = bytehash.mix(s ^ np.uint64(0x9FB21C651E98DF25)) & np.uint64(slots - 1)
    return np.packbits(np.bincount(spread.astype(np.int64), minlength=slots).astype(np.uint8) & 1)


def folded(sketch: np.ndarray) -> np.ndarray:
    """Sketches (rows) of half the slots."""
    half = sketch.shape[1] // 2
    return sketch[:, :half] ^ sketch[:, half:]


def _postings(join: Join, order: Order, boundary: int):
    """key, node, n, pos for every set: prefix elements, or with pos -c the subsets of c elements, told apart by the key's last bit.

    One more row of each large set has its sketch in ``bits``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = {n: subset_sizes(join, n, boundary) for n in range(1, boundary + 1)}
        one = np.uint64(1)
        for batch in batches:
            keys, nodes, ns, poss, bits = [], [], [], [], []

            def put(k: np.ndarray, pos: np.ndarray) -> None:
                keys.append(k), poss.append(pos), nodes.append(np.full(len(k), node)), ns.append(np.full(len(k), n)), bits.extend([None] * len(k))

            for node, s in zip(batch["node"], shingle_sets(batch["t"], join.size)):
                n = len(s)
                for c in sizes.get(n, ()):
                    k = subset_keys(s, c) | one
                    put(k, np.full(len(k), -c))
                if n > boundary or join.partners(n)[-1] > boundary:
                    k = order.arrange(s)[: join.prefix(n)] & ~one
                    put(k, np.arange(len(k)))
                    put(np.zeros(1, np.uint64), np.zeros(1, np.int64))
                    bits[-1] = parities(s).tobytes()
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "node": np.concatenate(nodes), "n": np.concatenate(ns).astype(np.int32), "pos": np.concatenate(poss).astype(np.int32), "bits": bits})

    return run


class Sketches:
    """The sketches of a list's entries, by number of slots; each stands under its own number and under half of it."""

    def __init__(self, bits: list[bytes]):
        width = np.array([len(b) for b in bits])
        self.width, self.at, self.rows = width, np.zeros((2, len(bits)), np.int64), {}
        for w in np.unique(np.concatenate([width, width // 2])).tolist():
            own, double = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
            self.at[0, own], self.at[1, double] = np.arange(len(own)), np.arange(len(own), len(own) + len(double))
            parts = [np.frombuffer(b"".join(bits[i] for i in own), np.uint8).reshape(-1, w)]
            parts.append(folded(np.frombuffer(b"".join(bits[i] for i in double), np.uint8).reshape(-1, 2 * w)))
            self.rows[w] = np.concatenate(parts)

    def differ(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of entries, in how many slots their sketches differ (0 where the sizes are too far apart) and how many slots there are."""
        out = np.zeros(len(x), np.int64)
        w = np.minimum(self.width[x], self.width[y])
        near = np.maximum(self.width[x], self.width[y]) <= 2 * w
        for v in np.unique(w[near]).tolist():
            p = np.flatnonzero(near & (w == v))
            a = self.rows[v][self.at[(self.width[x[p]] > v).astype(int), x[p]]]
            b = self.rows[v][self.at[(self.width[y[p]] > v).astype(int), y[p]]]
            out[p] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return out, 8 * w


class Forest:
    """Which entries of a list hang together already."""

    def __init__(self, labels: np.ndarray):
        _, self.up = np.unique(labels, return_inverse=True)
        self.label = self.up.copy()
        self.up = np.arange(self.up.max() + 1 if len(self.up) else 0)

    def grown(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of pairs in this order, those that join two trees; the trees are joined."""
        keep = np.zeros(len(x), bool)
        for k, (a, b) in enumerate(zip(self.label[x].tolist(), self.label[y].tolist())):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                keep[k] = True
        if keep.any():
            while (self.up != self.up[self.up]).any():
                self.up = self.up[self.up]
            self.label = self.up[self.label]
        return keep

    def root(self, a: int) -> int:
        while self.up[a] != a:
            a = int(self.up[a])
        return a


def _cross_pairs(join: Join, forest: bool):
    """Pairs from sorted inverted lists (key, i, j; comp, n, node, pos, block, bits): sets of different components that may link.

    Only sizes that can link and, counting from the shared element on, leave
        enough elements are paired, and of those only sets whose sketches don't show
    that they differ in too many elements. With ``forest`` sketches must be as
    close as those of linked sets are on the average, and a list gives no pair
    for sets that earlier pairs of it connect. Lists run on over batches.
    """

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        comp, n, node, pos, block = (g[c].to_numpy() for c in ("comp", "n", "node", "pos", "block"))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        cell = (g[["key", "i", "j"]] != g[["key", "i", "j"]].shift()).any(axis=1).cumsum().to_numpy()
        cut, sketches = g["i"].to_numpy() != g["j"].to_numpy(), Sketches(list(g["bits"]))
        trees = Forest(pd.MultiIndex.from_arrays([cell, comp]).factorize()[0]) if forest else None
        x, out = np.arange(len(g)), [np.empty((2, 0), np.int64)]
        for d in range(1, len(g)):
            # Entries and those d behind them; lists are sorted by size, so who has found the end of its partners is done.
            x = x[: np.searchsorted(x, len(g) - d)]
            y = x + d
            near = (cell[x] == cell[y]) & (join.den * n[x] >= join.num * n[y])
            x, y = x[near], y[near]
            if not len(x):
                break
            rest = np.minimum(n[x] - pos[x], n[y] - pos[y])
            total = n[x] + n[y]
            good = (comp[x] != comp[y]) & (~cut[x] | (block[x] != block[y])) & (rest * (join.num + join.den) >= join.num * total)
            if forest:
                good &= trees.label[x] != trees.label[y]
            a, b, most = x[good], y[good], join.most_apart(total[good])
            differ, slots = sketches.differ(a, b)
            fit = differ <= (slots / 2 * -np.expm1(-2 * most / slots) if forest else most)
            a, b = a[fit], b[fit]
            if forest and len(a):
                keep = trees.grown(a, b)
                a, b = a[keep], b[keep]
            out.append(np.stack([node[a], node[b]]))
        a, b = np.concatenate(out, axis=1)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []  # the list that the last batch ended in
        for batch in batches:
            last = batch.iloc[-1]
            new = ~((batch["key"] == last["key"]) & (batch["i"] == last["i"]) & (batch["j"] == last["j"]))
            if rest and new.any() or rest and (rest[0].iloc[0][["key", "i", "j"]] != last[["key", "i", "j"]]).any():
                yield pairs(pd.concat([*rest, batch[new]], ignore_index=True)).drop_duplicates()
                rest = []
            elif new.any():
                yield pairs(batch[new].reset_index(drop=True)).drop_duplicates()
            rest.append(batch[~new])
        if rest:
            yield pairs(pd.concat(rest, ignore_index=True)).drop_duplicates()

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes() for s in shingle_sets(batch["t"], size)]
            yield pd.DataFrame({"node": batch["node"], "s": sets})

    return run


def _verify(join: Join):
    def values(blob: bytes) -> np.ndarray:
        """Six high bytes of each hash, still sorted; hashes of the same two sets that differ only below don't occur in practice."""
        x = np.zeros((len(blob) // 6, 8), np.uint8)
        x[:, 2:] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
        return x.view(np.uint64).ravel()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["sa"], batch["sb"]):
                x, y = values(a), values(b)
                if len(x) > len(y):
                    x, y = y, x
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(join.den * same >= join.num * (len(x) + len(y) - same))
            yield batch.loc[keep, ["a", "b"]]

    return run


def verified(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Those of the distinct pairs whose sets link."""
    pairs = materialize(pairs.distinct(), "candidates")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(wanted, "candidate-nodes")
    s = materialize(sets.join(broadcast_if_small(wanted), "node", "left_semi").mapInPandas(_sets(join.size), "node long, s binary"), "candidate-sets")
    both = pairs.join(s.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    out = materialize(both.mapInPandas(_verify(join), "a long, b long"), "links-verified")
    release(pairs, wanted, s)
    return out


def apart_in_lists(lists: DataFrame, comp: DataFrame, bits: DataFrame, join: Join, forest: bool) -> DataFrame:
    """Pairs of sets of different components that share an inverted list (key, node, n, pos) and may link."""
    lists = lists.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    mixed = lists.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k")).filter("lo <> hi").select("key", "k")
    lists = lists.join(mixed, "key").join(bits, "node").withColumn("g", F.ceil(F.col("k") / LIST).cast("int"))
    lists = lists.withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    lists = lists.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "comp", "n", "node", "pos", "block", "bits")
    dealt = lists.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "node")
    return dealt.mapInPandas(_cross_pairs(join, forest), "a long, b long")


def links(sets: DataFrame, total: int, join: Join) -> DataFrame:
    """Links (a, b) between different sets (node, n, t) that give the same components as all links.

    Small sets meet in buckets of equal subsets, as large as the intersection
    that a link needs; a bucket's smallest set links with every other one that the
    sizes allow, and no further link could join more. Large sets are found by
    scanning inverted lists: first each list's smallest set against the others;
    then, where sets of a list are still in different components, a forest of
    the pairs whose sketches are alike; last, all pairs that are left and that
    the sketches allow. Few are, so pairs grow with the lists and hardly with
    their squares. Each candidate pair is verified on the sets.
    """
    order, length = frequency_order(sets, total, join.size)
    boundary = choose_boundary(join, length)
    made = sets.select("node", "t").mapInPandas(_postings(join, order, boundary), "key long, node long, n int, pos int, bits binary")
    made = materialize(made, "postings")
    entries = made.filter("bits is null").drop("bits")
    shared = materialize(entries.groupBy("key").count().filter("count > 1").select("key"), "shared-keys")
    met = materialize(entries.join(shared, "key", "left_semi"), "lists")
    bits = materialize(made.filter("bits is not null").select("node", "bits"), "sketches")
    release(made, shared)
    center = met.groupBy("key").agg(F.min(F.struct("n", "node", "pos")).alias("c"))
    others = met.join(center, "key").filter("node <> c.node").withColumn("total", F.col("n") + F.col("c.n"))
    pair = (F.col("c.node").alias("a"), F.col("node").alias("b"))
    need = F.lit(join.num) * F.col("total")
    sure = others.filter("pos < 0").filter(F.lit(join.num + join.den) * -F.col("pos") >= need).select(*pair).distinct()
    rest = F.least(F.col("n") - F.col("pos"), F.col("c.n") - F.col("c.pos"))
    tried = others.filter("pos >= 0").filter(F.lit(join.den) * F.col("c.n") >= F.lit(join.num) * F.col("n")).filter(F.lit(join.num + join.den) * rest >= need)
    found = materialize(sure.unionByName(verified(tried.select(*pair), sets, join)), "links-first")
    large = met.filter("pos >= 0")
    for forest in (True, False):
        comp = materialize(components(found), "components-so-far")
        found = materialize(found.unionByName(verified(apart_in_lists(large, comp, bits, join, forest), sets, join)), "links-found")
    release(met, bits)
    return found


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, t and a 128-bit key of both in ``ra`` and ``rb``, with the whole row in ``row``."""
    d = docs.select(packed(docs).alias("row"), F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return d.withColumn("ra", F.xxhash64("doc_id", "t")).withColumn("rb", F.xxhash64("t", "doc_id", F.lit("b")))


def joined(d: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """The signature of every row (doc_id, n, ka, kb), and of each class of equal sets its component and first row.

    ``d`` has doc_id, t, ra and rb. Rows come in order of key (null last).
    """
    kind = d.schema["doc_id"].dataType.simpleString()
    rows = materialize(d.mapInPandas(_signatures(join.size), f"doc_id {kind}, ra long, rb long, n long, ka long, kb long"), "set-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ra", "rb")).alias("first")
    classes = rows.filter("n > 0").groupBy("ka", "kb").agg(F.first("n").alias("n"), first)
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "set-classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at = classes.select(F.col("first.ra").alias("ra"), F.col("first.rb").alias("rb"), "node")
    texts = d.join(at.select("ra", "rb"), ["ra", "rb"], "left_semi").groupBy("ra", "rb").agg(F.first("t").alias("t"))
    sets = materialize(texts.join(at, ["ra", "rb"]).select("node", "t"), "sets")
    comp = materialize(components(links(sets, total, join)), "components")
    return rows, classes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))


def jaccard_components(docs: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and class for every row of ``docs``.

    Rows with equal sets form a class, which is joined once; ``class`` names it.
    ``component_id`` is the smallest key in the rows that links reach, the row's
    own key where there is none. Null and empty texts and those without words
    have an empty set and link with nothing. Rows with a null key take part and
    are passed over when the smallest key is sought. Equal rows and rows of equal
    keys are rows of their own. Other columns, whatever their names, are ignored;
    an empty table gives an empty result.
    """
    d = keyed(docs, key, text).drop("row")
    rows, classes = joined(d, join)
    least = classes.groupBy("component").agg(F.min("first").alias("f"))
    ids = classes.join(least, "component").select("ka", "kb", F.col("f.doc_id").alias("smallest"), "node")
    out = rows.join(materialize(ids, "class-ids"), ["ka", "kb"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"), F.col("node").alias("class"))


def keep_one(docs: DataFrame, join: Join = Join(5, 8, 10), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each group that links join, with all their columns as they are, whatever their names.

    The row with the smallest key stays (a null key is the largest), of rows with
    equal keys and texts any one. Texts without words are no group; all stay. An
    empty table gives an empty one.
    """
    d = keyed(docs, key, text)
    _, classes = joined(d.drop("row"), join)
    stay = materialize(classes.groupBy("component").agg(F.min("first").alias("f")).select("f.ra", "f.rb"), "keepers")
    empty = F.length(F.translate("t", SPACES, "")) == 0
    one = d.filter(~empty).join(stay, ["ra", "rb"], "left_semi").dropDuplicates(["ra", "rb"])
    return one.select("row.*").unionByName(d.filter(empty).select("row.*"))
