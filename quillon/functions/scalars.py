"""Scalar functions that Spark lacks or means in another way, as Column helpers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Date format letters of the two pattern languages, as Spark writes them.
TO_CHAR = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH24": "HH", "HH12": "hh", "MI": "mm", "SS": "ss", "MON": "MMM", "DY": "EEE", "Q": "Q"}
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%f": "ss.SSS", "%I": "hh", "%p": "a", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss"}


def concat_skip_null(*parts: Column) -> Column:
    """CONCAT that passes over nulls; all null gives an empty string."""
    return F.concat_ws("", *parts)


def regexp_replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replaces the first match only."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})", f"$1{replacement}")


def quote(text: Column) -> Column:
    """An SQL literal of the text; null gives the word NULL."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def trunc_number(x: Column, digits: int = 0) -> Column:
    """Cuts towards zero after so many decimals."""
    p = 10**digits
    return F.signum(x) * F.floor(F.abs(x) * p) / p


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 93 of them suffice for 64 bits."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.struct(
        F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(s["x"], s["y"])).alias("y")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.abs(a * b), gcd(a, b)), F.lit(0)).cast("long")


def log_any(x: Column, base: Column | None = None) -> Column:
    """LOG(x) is natural; LOG(b, x) has a base."""
    return F.ln(x) if base is None else F.ln(x) / F.ln(base)


def day_of_week(d: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(d) - 1).cast("long")


def to_char(d: Column, pattern: str) -> Column:
    for k in sorted(TO_CHAR, key=len, reverse=True):
        pattern = pattern.replace(k, TO_CHAR[k])
    return F.date_format(d, pattern)


def strftime(pattern: str, d: Column) -> Column:
    """Text of a time by percent directives; ``%s`` is the epoch in seconds, ``%w`` the weekday from Sunday 0, ``%J`` the Julian day, ``%%`` a percent sign."""
    parts, plain = [], ""
    i = 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        special = {"%s": lambda: F.unix_seconds(d.cast("timestamp")).cast("string"), "%w": lambda: day_of_week(d).cast("string"), "%J": lambda: julian_day(d).cast("string"), "%%": lambda: F.lit("%")}.get(two)
        if special or two in STRFTIME:
            if plain:
                parts.append(F.lit(plain))
                plain = ""
            parts.append(special() if special else F.date_format(d, STRFTIME[two]))
            i += 2
        else:
            plain += pattern[i]
            i += 1
    if plain:
        parts.append(F.lit(plain))
    return F.concat(*parts) if parts else F.lit("")


def number_to_char(x: Column, pattern: str) -> Column:
    """TO_CHAR of a number: 9 and 0 are digits, a comma groups, a point parts decimals; too large a number gives hash signs."""
    return F.to_char(x.cast(f"decimal(38,{len(pattern.partition('.')[2])})"), F.lit(pattern))


def julian_day(d: Column) -> Column:
    return F.unix_micros(d.cast("timestamp")) / F.lit(86400e6) + F.lit(2440587.5)


def date_modifier(d: Column, *modifiers: str) -> Column:
    """Date shifts written as ``+N unit``, ``start of`` day, month or year, or ``weekday N`` (the next such day, Sunday 0, itself if it is one), one after the other."""
    out = d
    for m in modifiers:
        if m.startswith("weekday "):
            out = (out + F.make_interval(days=F.pmod(F.lit(int(m.split()[1]) + 8) - F.dayofweek(out), F.lit(7)).cast("int"))).cast("timestamp_ntz")
        elif m.startswith("start of "):
            out = F.date_trunc(m.removeprefix("start of "), out).cast("timestamp_ntz")
        else:
            n, unit = m.split()
            out = out + F.expr(f"INTERVAL '{int(n)}' {unit.rstrip('s').upper()}")
    return out


SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def date_diff(later: Column, earlier: Column, unit: str = "day") -> Column:
    """``later - earlier`` in whole units; months, quarters and years count calendar ones."""
    unit = unit.lower().rstrip("s")
    if unit in SECONDS:
        seconds = F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))
        return F.floor(seconds / SECONDS[unit]).cast("long")
    months = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    return F.floor(months / {"month": 1, "quarter": 3, "year": 12}[unit]).cast("long")


def age(later: Column, earlier: Column) -> Column:
    """Whole years, months and days between two dates as text, with days borrowed from 30; parts of zero are left out, and no time at all is ``0 days``."""

    def part(n: Column, unit: str) -> Column:
        return F.when(n != 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(F.abs(n) == 1, "").otherwise("s")))

    months = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    days = F.day(later) - F.day(earlier)
    m = F.when(days < 0, months - 1).otherwise(months)
    d = F.when(days < 0, days + 30).otherwise(days)
    years = F.floor(m / 12)
    text = F.concat_ws(" ", part(years, "year"), part(m - years * 12, "mon"), part(d, "day"))
    return F.when(later.isNotNull() & earlier.isNotNull(), F.when(text == "", "0 days").otherwise(text))


def array_position_or_null(a: Column, x: Column) -> Column:
    return F.nullif(F.array_position(a, x), F.lit(0))


def type_name(c: Column) -> Column:
    """The five storage class names."""
    t = F.typeof(c)
    return (
        F.when(c.isNull(), "null").when(t.isin("int", "bigint", "smallint", "tinyint", "boolean"), "integer").when(t.isin("double", "float") | t.startswith("decimal"), "real").when(t == "binary", "blob").otherwise("text")
    )


def _steps(path: str) -> list[str | int]:
    out: list[str | int] = []
    for part in path.lstrip("$").replace("[", ".[").split("."):
        if part:
            out.append(int(part[1:-1]) if part[0] == "[" else part)
    return out


def _edit(text: str | None, path: str, value: object, make: bool, change: bool, drop: bool) -> str | None:
    try:
        doc = json.loads(text)
    except (TypeError, ValueError):
        return None
    at, steps = doc, _steps(path)
    for s in steps[:-1]:
        try:
            at = at[s]
        except (KeyError, IndexError, TypeError):
            return json.dumps(doc, separators=(",", ":"))
    last = steps[-1]
    there = last in at if isinstance(at, dict) else isinstance(at, list) and isinstance(last, int) and last < len(at)
    if drop:
        if there:
            del at[last]
    elif (there and change) or (not there and make and isinstance(at, dict)):
        at[last] = value
    elif not there and make and isinstance(at, list):
        at.append(value)
    return json.dumps(doc, separators=(",", ":"))


def _json_editor(path: str, value: object, make: bool, change: bool, drop: bool):
    @F.pandas_udf(StringType())
    def edit(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _edit(t, path, value, make, change, drop))

    return edit


def json_set(c: Column, path: str, value: object) -> Column:
    return _json_editor(path, value, True, True, False)(c)


def json_add(c: Column, path: str, by: float) -> Column:
    """JSON with a number at a path made larger; a missing one counts as 0, and what is no number stays."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                at = json.loads(t)
            except (TypeError, ValueError):
                return None
            for s in _steps(path):
                at = at.get(s) if isinstance(at, dict) else at[s] if isinstance(at, list) and isinstance(s, int) and s < len(at) else None
            if at is not None and (isinstance(at, bool) or not isinstance(at, (int, float))):
                return t
            return _edit(t, path, (at or 0) + by, True, True, False)

        return texts.map(one)

    return run(c)


def json_insert(c: Column, path: str, value: object) -> Column:
    return _json_editor(path, value, True, False, False)(c)


def json_replace(c: Column, path: str, value: object) -> Column:
    return _json_editor(path, value, False, True, False)(c)


def json_remove(c: Column, path: str) -> Column:
    return _json_editor(path, None, False, False, True)(c)


def json_type(c: Column, path: str = "$") -> Column:
    """The type at a path: object, array, text, integer, real, true, false or null; null where nothing is there."""
    v = F.try_variant_get(F.try_parse_json(c), path, "variant")
    t = F.schema_of_variant(v)
    truth = F.try_variant_get(v, "$", "boolean").cast("string")
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY"), "array")
        .when(t == "STRING", "text")
        .when(t == "BOOLEAN", truth)
        .when(t == "VOID", "null")
        .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .otherwise("real")
    )


def json_quote(c: Column) -> Column:
    """A value as JSON: text in quotes with escapes, null as ``null``."""
    j = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(j, F.lit(2), F.length(j) - 2))


def contains(doc: object, part: object) -> bool:
    """Whether a JSON value holds another: all keys of an object, all elements of an array in any order, or the same scalar."""
    if isinstance(part, dict):
        return isinstance(doc, dict) and all(k in doc and contains(doc[k], v) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(doc, list) and all(any(contains(x, p) for x in doc) for p in part)
    return type(doc) is type(part) and doc == part


def json_contains(part: object):
    """A column function for ``doc @> part``; malformed text gives null."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> bool | None:
            try:
                return contains(json.loads(t), part)
            except (TypeError, ValueError):
                return None

        return texts.map(one).astype("object")

    return run


def merge_patch(target: object, patch: object) -> object:
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


@F.pandas_udf(StringType())
def json_patch(texts: pd.Series, patches: pd.Series) -> pd.Series:
    def one(t: str | None, p: str | None) -> str | None:
        try:
            return json.dumps(merge_patch(json.loads(t), json.loads(p)), separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return pd.Series([one(t, p) for t, p in zip(texts, patches)])


def json_path(path: str):
    """A column function for paths with ``.*``, ``[*]``, ``..key`` and ``?(@.key > number)``: the matches as a JSON array."""
    import re

    tokens = re.findall(r"\.\.(\w+)|\.(\w+|\*)|\[(\d+|\*)\]|\?\(@\.(\w+)\s*(==|!=|>=|<=|>|<)\s*([^)]+)\)", path)

    def walk(v: object, key: str) -> list:
        out = [v[key]] if isinstance(v, dict) and key in v else []
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            out += walk(x, key)
        return out

    def find(doc: object) -> list:
        found = [doc]
        for deep, name, index, field, op, number in tokens:
            nxt: list = []
            for v in found:
                if deep:
                    nxt += walk(v, deep)
                elif "*" in (name, index):
                    nxt += list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
                elif name:
                    nxt += [v[name]] if isinstance(v, dict) and name in v else []
                elif index:
                    nxt += [v[int(index)]] if isinstance(v, list) and int(index) < len(v) else []
                elif isinstance(v, dict) and isinstance(v.get(field), (int, float)):
                    a, b = v[field], float(number)
                    if {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]:
                        nxt.append(v)
            found = nxt
        return found

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return json.dumps(find(json.loads(t)), separators=(",", ":"))
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return run
