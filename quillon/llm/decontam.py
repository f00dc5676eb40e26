"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, rare bigrams where samples don't do, exact edit verification."""

from __future__ import annotations

import functools
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import bytehash
from quillon.llm.common import fresh, materialize, packed

EDITS = 0.2  # a passage matches an item with up to this share of its words edited
MIN_WORDS = 5  # shorter items allow no edit and are searched by exact match
COORDINATES = 3  # embedding coordinates in a sample
PER_WALK = 8  # samples that share a walk
RECALL = 0.99  # aimed at on the items themselves with as many random edits as allowed
MAX_SAMPLES = 128  # items for which these don't reach the recall are searched by bigrams, which miss none
MAX_PAIRS = 1 << 22  # places of bigrams held at once
BLOCK_ITEMS = 20_000  # items in an index; more are searched in several rounds
BITMAP = 1 << 23

# First and last characters of scripts that don't part words by spaces, by Unicode block.
SPACELESS = (
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303C),
    (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9DF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xAA80, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x323AF),
)
PARTS, JOINS, ALONE = 0, 1, 2


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Of each character, whether it parts words, joins others to a word, or is a word of its own.

    White space, controls and punctuation part words, ASCII symbols too. Characters of scripts
    without spaces are words, and so are other symbols. Texts come case-folded.
    """
    out = np.full(0x110000, JOINS, np.uint8)
    for first, last in SPACELESS:
        out[first : last + 1] = ALONE
    for c in range(0x323B0):
        kind = unicodedata.category(chr(c))
        if kind[0] in "PZ" or kind in ("Cc", "Cs") or c == 0x200B or (c < 128 and not chr(c).isalnum()):
            out[c] = PARTS
        elif kind[0] == "S":
            out[c] = ALONE
        elif kind == "Nd":
            out[c] = JOINS
    return out


def as_points(text: str | None) -> np.ndarray:
    """The code points of a text, case-folded; null is empty."""
    return np.frombuffer((text or "").casefold().encode("utf-32-le", "surrogatepass"), np.uint32)


def bounds(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words."""
    kind = np.zeros(len(points) + 2, np.uint8)
    kind[1:-1] = classes()[points]
    joins, alone = kind == JOINS, kind == ALONE
    return np.flatnonzero(alone[1:-1] | (joins[1:-1] & ~joins[:-2])), np.flatnonzero(alone[1:-1] | (joins[1:-1] & ~joins[2:])) + 1


def tokens(points: np.ndarray) -> np.ndarray:
    """Hashes of a text's words, punctuation and case aside."""
    start, end = bounds(points)
    return bytehash.between(bytehash.prefix(points), start, end)


def embed(h: np.ndarray, starts: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """The CGK walk from each start: one row of ``steps`` words.

    At step j the walk puts out the word it stands on and moves on by the j-th
    random bit of that word, so an edit shifts two walks only until chance
    brings them together again. All walks of a seed share their bits.
    """
    out = np.empty((len(starts), steps), np.uint64)
    at = starts.copy()
    for j in range(steps):
        if j % 64 == 0:
            bits = bytehash.mix(h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (j // 64 + 1) * 0xD1B54A32D192ED03) % 2**64))
        out[:, j] = h[at]
        at += ((bits[at] >> np.uint64(j % 64)) & np.uint64(1)).astype(at.dtype)
        np.minimum(at, len(h) - 1, out=at)
    return out


def sample_key(walk: np.ndarray, columns: np.ndarray) -> np.ndarray:
    key = np.zeros(len(walk), np.uint64)
    for c in columns:
        key = key * np.uint64(bytehash.BASE) + walk[:, c]
    return bytehash.mix(key)


@dataclass
class Group:
    """Items of like length, with one sorted table of keys for each sample, or with one of bigrams if samples are too few."""

    items: list[int]
    reach: int  # words from a start in which an item's bigrams lie
    needed: int  # bigrams of the benchmark that a matching window keeps
    steps: int
    samples: list[tuple[int, np.ndarray]] = field(default_factory=list)  # seed of the walk, coordinates
    keys: list[np.ndarray] = field(default_factory=list)
    owners: list[np.ndarray] = field(default_factory=list)
    offsets: np.ndarray | None = None  # of the bigrams in their items; None: searched by samples


def edits_allowed(n: int) -> int:
    return int(EDITS * n)


def perturbed(h: np.ndarray, edits: int, r: np.random.Generator) -> np.ndarray:
    out = list(h)
    for _ in range(edits):
        i, kind = int(r.integers(len(out))), int(r.integers(3))
        word = np.uint64(r.integers(2**63))
        if kind == 0:
            out[i] = word
        elif kind == 1:
            out.insert(i, word)
        elif len(out) > 1:
            del out[i]
    return np.array(out, np.uint64)


class Index:
    """Keys of a block of items and the bitmap of their bigrams. Its size is bounded by BLOCK_ITEMS."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.words = [tokens(as_points(t)) for t in texts]
        self.counted = [np.unique(w, return_counts=True) for w in self.words]
        self.bigrams = np.zeros(BITMAP, bool)
        by_size: dict[int, list[int]] = defaultdict(list)
        short: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            if len(w) >= MIN_WORDS:
                by_size[int(np.log(len(w)) / np.log(1.4))].append(i)
                self.bigrams[self.slots(w)] = True
            elif len(w):
                short[len(w)].append(i)
        self.groups = [self.group(v) for _, v in sorted(by_size.items())]
        self.short: list[tuple[int, np.ndarray, np.ndarray]] = []  # words, sorted keys, items
        for n, v in sorted(short.items()):
            keys = np.concatenate([bytehash.shingles(self.words[i], n) for i in v])
            order = np.argsort(keys, kind="stable")
            self.short.append((n, keys[order], np.array(v)[order]))

    @staticmethod
    def pairs(w: np.ndarray) -> np.ndarray:
        """A hash for each bigram."""
        return bytehash.mix(w[:-1] * np.uint64(bytehash.BASE) + w[1:])

    @staticmethod
    def slots(w: np.ndarray) -> np.ndarray:
        return (Index.pairs(w) & np.uint64(BITMAP - 1)).astype(np.int64)

    def group(self, items: list[int]) -> Group:
        sizes = [len(self.words[i]) for i in items]
        g = Group(items, max(n + edits_allowed(n) for n in sizes), min(n - 1 - 2 * edits_allowed(n) for n in sizes), max(COORDINATES, int(1.5 * min(sizes))))
        r = np.random.default_rng(len(items) * 1009 + g.steps)
        pad = np.zeros(g.steps, np.uint64)
        clean = np.concatenate([np.concatenate([self.words[i], pad]) for i in items])
        at = np.concatenate([[0], np.cumsum([len(self.words[i]) + g.steps for i in items])[:-1]]).astype(np.int64)
        # A bounded trial on the items says how many samples reach the recall.
        tried = [items[k] for k in r.integers(len(items), size=min(300, 20 * len(items)))]
        rough = [perturbed(self.words[i], edits_allowed(len(self.words[i])), r) for i in tried]
        rough_all = np.concatenate([np.concatenate([np.zeros(1, np.uint64), x, pad]) for x in rough])
        rough_at = np.concatenate([[0], np.cumsum([len(x) + g.steps + 1 for x in rough])[:-1]]).astype(np.int64)
        found = np.zeros(len(tried), bool)
        place = {i: k for k, i in enumerate(items)}
        truth = np.array([place[i] for i in tried])
        for s in range(MAX_SAMPLES):
            seed = s // PER_WALK + 1
            if s % PER_WALK == 0:
                walk = embed(clean, at, g.steps, seed)
                near = [embed(rough_all, rough_at + o, g.steps, seed) for o in (0, 1, 2, 3)]
            columns = np.sort(r.choice(g.steps, COORDINATES, replace=False))
            keys = sample_key(walk, columns)
            order = np.argsort(keys, kind="stable")
            g.samples.append((seed, columns)), g.keys.append(keys[order]), g.owners.append(order)
            for x in near:
                found |= sample_key(x, columns) == keys[truth]
            if s >= PER_WALK - 1 and found.mean() >= RECALL:
                return g
        return self.by_bigrams(g)

    def by_bigrams(self, g: Group) -> Group:
        """The group with 2k + 1 bigrams of each item, its rarest in the group, in place of samples.

        Each of k edits takes two bigrams of an item at most, so a matching passage
        keeps at least one of these whatever the edits are.
        """
        every = [self.pairs(self.words[i]) for i in g.items]
        hashes, count = np.unique(np.concatenate(every), return_counts=True)
        keys, owners, offsets = [], [], []
        for i, b in zip(g.items, every):
            rare = np.argsort(count[np.searchsorted(hashes, b)], kind="stable")[: 2 * edits_allowed(len(b) + 1) + 1]
            keys.append(b[rare]), owners.append(np.full(len(rare), i)), offsets.append(rare)
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        return Group(g.items, g.reach, g.needed, g.steps, keys=[key[order]], owners=[np.concatenate(owners)[order]], offsets=np.concatenate(offsets)[order])

    def bigram_candidates(self, g: Group, h: np.ndarray, doc: np.ndarray, sums: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(place, item, words by which the place may be too early, text) where a bigram of an item stands among enough bigrams of the benchmark."""
        (keys,), (owners,) = g.keys, g.owners
        b = self.pairs(h)
        p = np.arange(len(b))
        dense = sums[np.minimum(p + g.reach, len(sums) - 1)] - sums[np.maximum(p - g.reach, 0)] >= g.needed
        p = p[dense & (doc[1:] == doc[:-1])]
        lo, hi = np.searchsorted(keys, b[p]), np.searchsorted(keys, b[p], side="right")
        p, lo, n = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        size = np.array([len(w) for w in self.words])
        upto = np.cumsum(n)
        a, parts = 0, []
        while a < len(p):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MAX_PAIRS, side="right")))
            at = np.repeat(p[a:z], n[a:z])
            k = np.repeat(lo[a:z] - np.concatenate([[0], np.cumsum(n[a:z])[:-1]]), n[a:z]) + np.arange(len(at))
            item, start = owners[k], at - g.offsets[k]
            edits = (EDITS * size[item]).astype(np.int64)
            have = sums[np.clip(start + size[item] + edits, 0, len(sums) - 1)] - sums[np.clip(start - edits, 0, len(sums) - 1)]
            keep = have >= size[item] - 1 - 2 * edits
            parts.append(np.unique(np.stack([item[keep], doc[at[keep]], start[keep]]), axis=1))
            a = z
        if not parts:
            return
        last = None
        for i, d, at in np.unique(np.concatenate(parts, axis=1), axis=1).T.tolist():
            if last is not None and last[:2] == (i, d) and at - last[2] <= edits_allowed(len(self.words[i])):
                last = (i, d, last[2], at)
                continue
            if last is not None:
                yield last[2], last[0], last[3] - last[2], last[1]
            last = (i, d, at, at)
        if last is not None:
            yield last[2], last[0], last[3] - last[2], last[1]

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(place, item, words by which the place may be too early, text) of equal samples or bigrams, over all starts in the words of several texts.

        Starts that can't match are left out first: with k edits an item of n
        words keeps n - 1 - 2k of its bigrams, so a matching window has as many
        of the benchmark's. This loses nothing and names no item.
        """
        if len(h) < 2:
            return
        known = self.bigrams[self.slots(h)] & (doc[1:] == doc[:-1])
        sums = np.zeros(len(h), np.int32)
        np.cumsum(known, out=sums[1:])
        for g in self.groups:
            if g.offsets is not None:
                yield from self.bigram_candidates(g, h, doc, sums)
                continue
            ahead = np.concatenate([sums[g.reach :], np.full(min(g.reach, len(h)), sums[-1])])
            starts = np.flatnonzero(ahead - sums >= g.needed)
            if not len(starts):
                continue
            seen: set[tuple[int, int]] = set()
            last = 0
            for (seed, columns), keys, owners in zip(g.samples, g.keys, g.owners):
                if seed != last:
                    walk, last = embed(h, starts, g.steps, seed), seed
                k = sample_key(walk, columns)
                lo = np.searchsorted(keys, k)
                for x in np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == k):
                    y = lo[x]
                    while y < len(keys) and keys[y] == k[x]:
                        seen.add((int(starts[x]), g.items[owners[y]]))
                        y += 1
            yield from ((at, i, 0, int(doc[at])) for at, i in seen)

    def exact(self, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) pairs of items that allow no edit, by equal runs of words."""
        for n, keys, items in self.short:
            if len(h) < n:
                continue
            k = bytehash.shingles(h, n)
            lo, hi = np.searchsorted(keys, k), np.searchsorted(keys, k, side="right")
            at = np.flatnonzero((hi > lo) & (doc[n - 1 :] == doc[: len(k)]))
            # Equal runs have equal items, so one of each in a text will do.
            for text, a, z in np.unique(np.stack([doc[at], lo[at], hi[at]]), axis=1).T.tolist():
                yield from ((text, int(i)) for i in items[a:z])

    def search(self, h: np.ndarray, doc: np.ndarray) -> dict[tuple[int, int], int]:
        """For each text and item that match, their least edit distance at a candidate place."""
        best: dict[tuple[int, int], int] = dict.fromkeys(self.exact(h, doc), 0)
        for at, i, late, text in sorted(self.candidates(h, doc)):
            pair = (text, i)
            if best.get(pair) == 0:
                continue
            w = self.words[i]
            k = edits_allowed(len(w))
            first, end = np.searchsorted(doc, [pair[0], pair[0] + 1])
            if first <= at and at + len(w) <= end and (h[at : at + len(w)] == w).all():
                best[pair] = 0
                continue
            region = h[max(first, at - k) : min(end, at + late + len(w) + k)]
            known, often = self.counted[i]
            place = np.minimum(np.searchsorted(known, region), len(known) - 1)
            have = np.bincount(place[known[place] == region], minlength=len(known))
            if np.minimum(have, often).sum() < len(w) - k:
                continue  # each word of the item that stays stands at a place of its own
            d = edit_distance(w, region)
            if d <= k:
                best[pair] = min(d, best.get(pair, d))
        return best


def edit_distance(item: np.ndarray, region: np.ndarray) -> int:
    """Edits, in words, that turn the item into the nearest passage of the region."""
    m = len(region)
    idx = np.arange(m + 1)
    row = np.zeros(m + 1, np.int64)
    for i, w in enumerate(item):
        t = np.empty(m + 1, np.int64)
        t[0] = i + 1
        t[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != w))
        row = np.minimum.accumulate(t - idx) + idx
    return int(row.min())


def find_hits(texts: list[str | None], index: Index, chunk: int = 1 << 19) -> list[list[tuple[int, int]]]:
    """(item, distance) pairs for each text. Texts of about ``chunk`` characters are searched at once; a long text is one of its own."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    parts, rows, held = [], [], 0

    def flush() -> None:
        joined = np.concatenate(parts)
        start, end = bounds(joined)
        h = bytehash.between(bytehash.prefix(joined), start, end)
        doc = np.repeat(np.arange(len(parts)), np.diff(np.searchsorted(start, np.cumsum([0, *(len(p) for p in parts)]))))
        for (d, i), distance in sorted(index.search(h, doc).items()):
            out[rows[d]].append((i, distance))

    gap = np.full(1, 32, np.uint32)
    for row, t in enumerate(texts):
        if t:
            parts.append(np.concatenate([as_points(t), gap])), rows.append(row)
            held += len(parts[-1])
            if held > chunk:
                flush()
                parts, rows, held = [], [], 0
    if parts:
        flush()
    return out


def blocks_of_items(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """The benchmark's items in blocks of bounded size, by way of the driver."""
    ids, texts = [], []
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(r[0]), texts.append(r[1])
        if len(ids) == BLOCK_ITEMS:
            yield ids, texts
            ids, texts = [], []
    yield ids, texts


def searcher(index: Broadcast, kind: str) -> Callable[[Column], Column]:
    """A column function that looks a text up in an index that every task has."""

    @F.pandas_udf(kind)
    def hits(texts: pd.Series) -> pd.Series:
        ids = index.value.ids
        return pd.Series([[{"item_id": ids[i], "distance": d} for i, d in x] for x in find_hits(list(texts), index.value)])

    return hits


def searched(docs: DataFrame, benchmark: DataFrame, text: str) -> DataFrame:
    """``row`` with the whole row and ``hits``; see :func:`with_hits`.

    A benchmark of one block is searched in one pass. Of a larger one, block after
    block goes to the tasks; the hits of each are stored, and they are joined to the
    rows by 128 bits of the text, so no task ever holds two blocks.
    """
    kind = f"array<struct<item_id:{benchmark.schema['item_id'].dataType.simpleString()},distance:int>>"
    spark, none = docs.sparkSession, F.array().cast(kind)
    d = docs.select(packed(docs).alias("row"), F.col(text).alias("t"))
    keys = (F.xxhash64("t").alias("ra"), F.xxhash64("t", F.lit("b")).alias("rb"))
    blocks = blocks_of_items(benchmark)
    block, parts = next(blocks), []
    while True:
        index, block = Index(*block), next(blocks, None)
        if index.groups or index.short:
            sent = spark.sparkContext.broadcast(index)
            hits = searcher(sent, kind)(F.col("t"))
            if block is None and not parts:
                return d.select("row", hits.alias("hits"))
            found = d.select(*keys, hits.alias("hits")).filter(F.size("hits") > 0).dropDuplicates(["ra", "rb"])
            parts.append(materialize(found, "block-hits"))
            sent.destroy()
        if block is None:
            break
    if not parts:
        return d.select("row", none.alias("hits"))
    every = functools.reduce(DataFrame.unionByName, parts).groupBy("ra", "rb").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    return d.select("row", *keys).join(every, ["ra", "rb"], "left").select("row", F.coalesce("hits", none).alias("hits"))


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hits") -> DataFrame:
    """Adds the matching items to every row, as an array of item_id and distance, sorted; empty without a match.

    Words count without case and punctuation. An item of n words matches if a
    passage differs from it in at most a fifth of n edits of whole words, so one
    of under five words only by an equal passage. Characters of scripts without
    spaces count as words. Null and empty texts match nothing, nor do null items
    and those without a word; an empty benchmark matches nothing. Items with equal
    ids are items of their own. Columns of the input stay as they are; where one
    is called ``out``, the new one gets an underscore. An empty table stays empty.
    """
    (name,) = fresh(docs.columns, out)
    return searched(docs, benchmark, text).select("row.*", F.col("hits").alias(name))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance: one row for each document and item that it holds; other columns are ignored."""
    found = searched(docs.select("doc_id", "text"), benchmark, "text")
    return found.select("row.doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.distance")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns as they are."""
    return searched(docs, benchmark, "text").filter(F.size("hits") == 0).select("row.*")
