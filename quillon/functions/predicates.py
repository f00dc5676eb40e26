"""Predicates that Spark SQL has no syntax for."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    """x BETWEEN SYMMETRIC a AND b: the bounds in either order."""
    return x.between(F.least(a, b), F.greatest(a, b)) & a.isNotNull() & b.isNotNull()


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for a GLOB pattern with ``*``, ``?`` and character classes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def similar_to_regex(pattern: str) -> str:
    """An anchored regular expression for SIMILAR TO: ``%`` and ``_`` are wildcards, ``( ) | [ ] * + ?`` as in regular expressions."""
    out = ""
    for c in pattern:
        out += {"%": "(?s:.*)", "_": "(?s:.)"}.get(c, c if c in "()|[]*+?{},-^" or c.isalnum() else re.escape(c))
    return f"^(?:{out})$"


def any_of(rows: DataFrame, values: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """Rows for which the test holds with any value of the one column of ``values``; none if there are no values."""
    v = values.select(F.col(values.columns[0]).alias("__v"))
    return rows.join(v, test(F.col("__v")), "left_semi")


def all_of(rows: DataFrame, values: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """Rows for which the test holds with all values; every row if there are none, and none is kept over an unknown."""
    v = values.select(F.col(values.columns[0]).alias("__v"))
    return rows.join(v, F.coalesce(~test(F.col("__v")), F.lit(True)), "left_anti")


def likely(condition: Column) -> Column:
    """A hint that a condition mostly holds; the rows are those of the condition."""
    return F.coalesce(condition, F.lit(False))


def unlikely(condition: Column) -> Column:
    """A hint that a condition rarely holds; the rows are those of the condition."""
    return F.coalesce(condition, F.lit(False))


def compared_with_all(values: DataFrame) -> DataFrame:
    """One row with what decides an ordered comparison with ANY or ALL values: least, most, n and how many are null."""
    v = F.col(values.columns[0])
    return values.agg(F.min(v).alias("least"), F.max(v).alias("most"), F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("unknown"))


def ordered(rows: DataFrame, values: DataFrame, left: Column, op: str, every: bool) -> DataFrame:
    """Rows with ``left op ANY`` or, with ``every``, ``left op ALL`` of the values, for < <= > >=.

    The values' extremes decide, so one row is sent to the tasks however many there are.
    """
    low = (op in ("<", "<=")) == every  # must be under all, or over any
    bound = F.col("__v.least") if low else F.col("__v.most")
    test = {"<": left < bound, "<=": left <= bound, ">": left > bound, ">=": left >= bound}[op]
    one = compared_with_all(values).select(F.struct("*").alias("__v"))
    known = F.coalesce(test, F.lit(False))
    hit = (F.col("__v.n") == 0) | (known & (F.col("__v.unknown") == 0)) if every else known
    return rows.crossJoin(F.broadcast(one)).filter(hit).select(*rows.columns)


# Endings taken off a word, the longest that fits first, with what takes their place.
ENDINGS = {"ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "ingly": "", "edly": "", "ies": "y", "ing": "", "ed": "", "ly": "", "es": "", "s": ""}


def stem(word: Column) -> Column:
    """A word without a common English ending and then without a last ``e``, if at least three letters are left; a double ``s`` stays."""
    out = word
    for ending in sorted(ENDINGS, key=len):
        fits = F.length(word) >= len(ending) + 3
        if ending == "s":
            fits = fits & ~word.endswith("ss")
        out = F.when(word.endswith(ending) & fits, F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(ENDINGS[ending]))).otherwise(out)
    return F.regexp_replace(out, "(?<=...)e$", "")


def asked(query: str) -> list[str]:
    return re.findall("[a-z0-9]+", query.lower())


def stems_asked(words: list[str]) -> Column:
    return F.transform(F.array(*[F.lit(w) for w in words]).cast("array<string>"), stem)


def stems_near(text: Column, words: list[str]) -> Column:
    """The text's words as stems; those that don't begin like a word asked for are empty, since a stem keeps the first three letters."""
    starts = sorted({w[:3] for w in words})
    return F.transform(word_array(text), lambda w: F.when(F.substring(w, 1, 3).isin(*starts), stem(w)).otherwise(""))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_stems(text: Column, query: str) -> Column:
    """MATCH AGAINST: whether every stemmed word of the query is a stemmed word of the text."""
    words = asked(query)
    return F.size(F.array_except(stems_asked(words), stems_near(text, words))) == 0


def words_in_row(text: Column, words: list[str]) -> Column:
    """Whether the words stand next to each other in a text, as whole words (runs of ASCII letters and digits); one pass over the text."""
    if not all(re.fullmatch("[a-z0-9]+", w) for w in words):
        return text.isNotNull() & F.lit(False)
    lower = F.lower(F.replace(text, F.lit("\u0130"), F.lit("i")))  # as DuckDB has it; Spark makes two characters of a dotted capital I
    return lower.rlike(f"(?<![a-z0-9]){'[^a-z0-9]++'.join(words)}(?![a-z0-9])") if words else text.isNotNull()


def ts_query(text: Column, query: str, stems: bool = True) -> Column:
    """Whether a text answers a query of words with ``&``, ``|``, ``!``, ``<->`` (next word) and parentheses; by stems, or by the words as they are."""
    tokens = re.findall(r"[a-z0-9]+|<->|[&|!()]", query.lower())
    at = 0

    def test(found: Column) -> Column:
        def phrase(ws: list[str]) -> Column:
            if not stems:
                return words_in_row(found, ws)
            if len(ws) == 1:
                return F.array_contains(found, stem(F.lit(ws[0])))
            run = stems_asked(ws)
            return F.exists(F.filter(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1))), lambda i: i + len(ws) - 1 <= F.size(found)), lambda i: F.slice(found, i, F.lit(len(ws))) == run)

        def unit() -> Column:
            nonlocal at
            t = tokens[at]
            at += 1
            if t == "!":
                return ~unit()
            if t == "(":
                inner = either()
                at += 1
                return inner
            ws = [t]
            while at + 1 < len(tokens) and tokens[at] == "<->":
                ws.append(tokens[at + 1])
                at += 2
            return phrase(ws)

        def both() -> Column:
            nonlocal at
            out = unit()
            while at < len(tokens) and tokens[at] == "&":
                at += 1
                out = out & unit()
            return out

        def either() -> Column:
            nonlocal at
            out = both()
            while at < len(tokens) and tokens[at] == "|":
                at += 1
                out = out | both()
            return out

        return either()

    return F.coalesce(once(stems_near(text, asked(query)), test) if stems else test(text), F.lit(False))


def ts_rank(text: Column, query: str) -> Column:
    """Share of a text's words that are words of the query, by stems."""
    words = asked(query)
    share = lambda stems: F.try_divide(F.size(F.filter(stems, lambda w: F.array_contains(stems_asked(words), w))).cast("double"), F.size(stems))
    return F.coalesce(once(stems_near(text, words), share), F.lit(0.0))


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def match_against(text: Column, query: str) -> Column:
    """Whether every word of the query is a word of the text."""
    found = word_array(text)
    out = F.lit(True)
    for w in re.findall("[a-z0-9]+", query.lower()):
        out = out & F.array_contains(found, w)
    return out


def ts_match(text: Column, query: str) -> Column:
    """Whether every ``&`` term of the query is part of the text."""
    out = F.lit(True)
    for w in re.split(r"\s*&\s*", query.lower()):
        out = out & F.contains(F.lower(text), F.lit(w))
    return out
