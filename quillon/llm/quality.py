"""Quality rules as a short-circuit cascade, with built-in functions only."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACES, let, materialize, words

# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5  # words in a window that may repeat
SAMPLE_CHARS = 1 << 16  # longer texts are left out of the sample, so that its size is bounded
WORK = 1 << 21  # characters over which a rule's time is taken, by repeating the sample


@dataclass(frozen=True)
class Rule:
    """A named condition that rejects a row; it may read any column of the input."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Measured:
    """What a bounded sample says about a rule."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        """Share of rows rejected per second of work: the larger, the earlier the rule runs."""
        return self.rejected / self.seconds


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the same array.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. The
    windows are sorted with their places only in texts that have a repeat at
    all; everything is linear or n log n in the text, so very long and very
    repetitive texts are fine.
    """

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - window),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]),
        )

    def covered(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = F.filter(
                s,
                lambda x, k: (x["g"] == F.get(s, k - 1)["g"]).eqNullSafe(True) | (x["g"] == F.get(s, k + 1)["g"]).eqNullSafe(True),
            )
            return F.array_sort(F.transform(twin, lambda x: x["i"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, places), total)

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(h) < window + 1, F.lit(0).cast("long")).otherwise(
            let(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))
        )

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), of_hashes)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def metric(name: str, text: Column, tokens: Column) -> Column:
    """The expression of one count over a text that isn't null and its words."""
    if name == "n_words":
        return F.size(tokens).cast("long")
    if name == "word_chars":
        return F.length(F.array_join(tokens, "")).cast("long")
    if name == "n_symbols":
        return F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")
    if name == "n_dup_lines":
        return duplicate_lines(text)
    return repeat_words(tokens)


def with_words(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``__t`` and ``__w``, the text (null: empty) and its words, for :func:`metric`."""
    return docs.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumn("__w", words(F.col("__t")))


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the contract's counts and ``base_failed``; a null text counts as empty. Input columns of these names go."""
    d = with_words(docs, text)
    kept = [c for c in docs.columns if c not in (*NAMES, "base_failed")]
    d = d.select(*kept, *[metric(n, F.col("__t"), F.col("__w")).alias(n) for n in NAMES])
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def default_rules(m: Callable[[str], Column] = F.col) -> list[Rule]:
    """Conservative rules; clean prose is far from every one of them. ``m`` gives the expression of a count."""
    return [
        Rule("repeats", 100 * m("n_repeat_words") > 20 * m("n_words")),
        Rule("too_short", m("n_words") < 10),
        Rule("duplicate_lines", 4 * m("n_dup_lines") > m("n_words")),
        Rule("long_words", m("word_chars") > 40 * m("n_words")),
        Rule("symbols", 100 * m("n_symbols") > 6 * m("word_chars")),
    ]


def sampled(docs: DataFrame, rows: int, text: str) -> DataFrame:
    """Up to ``rows`` texts of at most SAMPLE_CHARS characters, from as few partitions as hold them, stored once with ``t`` and the words ``w``."""
    some = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).filter(F.length("t") <= SAMPLE_CHARS).limit(rows).collect()
    d = docs.sparkSession.createDataFrame(some, "t string").coalesce(1)
    return materialize(d.withColumn("w", words(F.col("t"))), "quality-sample")


def measure(sample: DataFrame, rules: Sequence[Rule]) -> list[Measured]:
    """The time that each rule takes alone over a bounded sample, which is repeated so that starting a job doesn't count, and the share of rows it rejects."""
    n, chars = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    again = max(1, min(4096, WORK // max(1, chars)))
    repeated = sample.withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(again))))

    def timed(test: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hit = repeated.agg(F.sum(test.cast("long"))).first()[0] or 0
        return time.perf_counter() - began, hit

    timed(F.size("w") < 0)  # the first job compiles code
    base, _ = timed(F.size("w") < 0)
    out = []
    for r in rules:
        took, hit = timed(F.coalesce(r.rejects, F.lit(False)))
        out.append(Measured(r, max(1e-3, took - base), hit / max(n * again, 1)))
    return out


def order(measured: Sequence[Measured]) -> list[Rule]:
    """Rules by rejections per cost, best first; ties keep the order given."""
    return [m.rule for m in sorted(measured, key=lambda m: -m.rank)]


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule in this order that rejects the row, null if none does.

    One CASE expression: Spark evaluates its branches in turn and stops at the
    first that holds, so a rule runs only on rows that all earlier ones passed.
    A condition that is null doesn't reject.
    """
    out = None
    for r in rules:
        out = F.when(r.rejects, F.lit(r.name)) if out is None else out.when(r.rejects, F.lit(r.name))
    return out if out is not None else F.lit(None).cast("string")


def apply_rules(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 400, text: str = "text") -> DataFrame:
    """Adds the counts, ``failed_rule`` and ``kept`` to every row.

    Rules of one's own read the counts by name and come in the order given. The
    default ones are ordered by rejections per cost on ``sample_rows`` rows, which
    never decides what is kept, only which rule is named and what runs first.
    """
    ordered = list(ranked(docs, sample_rows, text, F.col)) if rules is None else list(rules)
    scored = with_metrics(docs, text).withColumn("failed_rule", cascade(ordered))
    return scored.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def ranked(docs: DataFrame, sample_rows: int, text: str, m: Callable[[str], Column]) -> list[Rule]:
    """The default rules over counts ``m``, in the order that the sample gives."""
    own = default_rules(lambda n: metric(n, F.col("t"), F.col("w")))
    names = [r.name for r in order(measure(sampled(docs, sample_rows, text), own))]
    rules = {r.name: r for r in default_rules(m)}
    return [rules[n] for n in names]


def keep(docs: DataFrame, sample_rows: int = 400, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no default rule rejects, with their columns as they are, whatever their names.

    A text is split into words once. The counts stand inside the CASE, so those of
    a later rule are never computed for a row that an earlier one rejects. Null and
    empty texts are too short. Repeated rows are judged one by one; an empty table stays empty.
    """
    names = [r.name for r in ranked(docs, sample_rows, text, F.col)]

    def verdict(w: Column) -> Column:
        rules = {r.name: r for r in default_rules(lambda n: metric(n, F.coalesce(F.col(text), F.lit("")), w))}
        return cascade([rules[n] for n in names])

    return docs.filter(let(words(F.col(text)), verdict).isNull())


def quality(docs: DataFrame) -> DataFrame:
    """One row for each document: the counts, whether the base rules fail, whether it is kept.

    Null and empty texts have no words, so the base rules fail them. Repeated
    rows are judged one by one. Columns beyond doc_id and text are ignored; an
    empty table gives an empty result.
    """
    out = apply_rules(docs.select("doc_id", "text"))
    return out.select("doc_id", *NAMES, "base_failed", "kept")
