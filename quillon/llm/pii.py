"""Personal data: overlapping span generators, boosted trees over format and context, a calibrated threshold for each generator; built-in functions only."""

from __future__ import annotations

import functools
import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fresh, let, packed, running_sums

# Kinds in the order of the contract, then those of the method alone.
KINDS = ("email", "ip", "card", "phone", "id", "secret", "iban", "name", "address")

# Base patterns. Each finds what the contract's plain pattern finds. Possessive
# quantifiers and starts at the head of a run keep long runs linear and off the stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must match for a pattern to match at all; a cheap test before the search.
NEEDS = {"email": "@", "ip": r"\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "masked": r"(?i)[\(\[\{]at[\)\]\}]", "local": "[0-9]", "number": "[0-9]-[0-9]", "token": "[0-9]", "password": "(?i)pass|pwd|secret", "iban": "[A-Z]{2}[0-9]{2}", "ipv6": "[0-9A-Fa-f]:", "person": "(?i)name", "street": r"[0-9]\x20[A-Z]"}
# Words that end the name of a street.
STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Square|Place|Terrace|Way"
# Generators of further candidates, by the kind that they would be. They look for
# recall and overlap; what they take for data is up to the trees.
GENERATORS = {
    "masked": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\(\[\{](?i:at)[\)\]\}]\x20?[A-Za-z0-9-]++(?:\x20?[\(\[\{](?i:dot)[\)\]\}]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"),
    "local": ("phone", r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9])"),
    "number": ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "token": ("secret", r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![.@])"),
    "password": ("secret", r"(?<=(?i:password|passwd|passphrase|pwd|secret)[\"']{0,1}\x20{0,2}[:=]\x20{0,2}[\"']{0,1})[^\s\"'<>,;]{4,}+"),
    "iban": ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"),
    "ipv6": ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){0,6}+(?![0-9A-Za-z:.])"),
    "person": ("name", r"(?<=(?i:name\x20is|name:|named)\x20{1,2})\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++){0,3}"),
    "street": ("address", rf"(?<![0-9A-Za-z])[0-9]{{1,5}}\x20(?:\p{{Lu}}\p{{Ll}}++\x20){{1,3}}(?:{STREETS})(?![A-Za-z])"),
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CUES = {
    "phone": r"(?i)(?:call|phone|tel|fax|mobile|cell|contact|reach|whatsapp|number)\W{0,4}(?:\w{0,8}\W{1,3})?$",
    "id": r"(?i)(?:ssn|social|security|id)\W{0,4}(?:\w{0,8}\W{1,3})?$",
    "secret": r"(?i)(?:token|secret|key|bearer|password|passwd|passphrase|pwd|credential|auth)\w{0,8}\W{0,4}(?:\w{0,8}\W{1,3})?$",
    "address": r"(?i)(?:address|live|lives|living|reside|located|ship|deliver|home)\W{0,4}(?:\w{0,8}\W{1,3})?$",
    "digest": r"(?i)(?:commit|sha-?[0-9]*|md5|checksum|digest|revision|hash|etag|blob)\W{0,4}(?:\w{0,8}\W{1,3})?$",
    "path": r"(?:[:/]/|/|href=.|src=.|\\)$",
}
SPAN = "struct<start:bigint,end:bigint,value:string,left:string,right:string>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The contract's test of a base match."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))


def spans(text: Column, pattern: str, needs: str) -> Column:
    """Matches of ``pattern`` with place (code points, end exclusive), value and 32 characters of what is around.

    Places are running sums over the lengths of matches and of the pieces between them.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def place(found: Column) -> Column:
        def build(pieces: Column) -> Column:
            lengths = F.transform(found, lambda v, i: (F.length(F.get(pieces, i)) + F.length(v)).cast("long"))
            return let(
                running_sums(lengths),
                lambda sums: F.transform(
                    found,
                    lambda v, i: let(
                        F.get(sums, i) + F.length(F.get(pieces, i)),
                        lambda at: F.struct(
                            at.alias("start"),
                            (at + F.length(v)).alias("end"),
                            v.alias("value"),
                            F.right(F.get(pieces, i), F.lit(32)).alias("left"),
                            F.left(F.get(pieces, i + 1), F.lit(1)).alias("right"),
                        ),
                    ),
                ),
            )

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), build))

    return F.when(text.rlike(needs), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(none)


def remainder97(value: Column) -> Column:
    """The check of an IBAN: 1 if it holds, 0 if not; letters count as numbers from 10 on."""
    v = F.regexp_replace(value, "[^0-9A-Z]", "")
    turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 58, (acc * 10 + n - 48) % 97).otherwise((acc * 100 + n - 55) % 97)

    return (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1).cast("int")


def features(generator: Column, value: Column, left: Column, right: Column) -> dict[str, Column]:
    """What generator proposed a candidate, its format and its context, as numbers."""
    count = lambda p: F.regexp_count(value, F.lit(p))
    names = list(GENERATORS)
    is_ = lambda name: generator == names.index(name)
    cue = lambda name: left.rlike(CUES[name]).cast("int")
    digits = F.regexp_replace(value, "[^0-9]", "")
    return {
        "generator": generator,
        "digits": F.length(digits),
        "upper": count("[A-Z]"),
        "lower": count("[a-z]"),
        "marks": count("[^A-Za-z0-9\x20]"),
        "length": F.length(value),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))),
        "changes": count("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"),
        "hex": value.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("int"),
        "groups": count("[:/]"),
        "check": F.when(is_("iban"), remainder97(value)).otherwise(F.lit(-1)),
        "cue": F.when(is_("local"), cue("phone")).when(is_("number"), cue("id")).when(is_("street"), cue("address")).when(is_("token") | is_("password"), cue("secret")).otherwise(F.lit(-1)),
        "digest": cue("digest"),
        "path": cue("path"),
        "left_word": left.rlike("[A-Za-z0-9#$%&*]$").cast("int"),
        "right_word": right.rlike("[A-Za-z0-9#$%&*/]").cast("int"),
        "opens": value.startswith("(").cast("int"),
    }


@dataclass(frozen=True)
class Tree:
    """A tree of depth two: feature and threshold at the root and in both children, and four leaves."""

    root: tuple[int, float]
    sides: tuple[tuple[int, float], tuple[int, float]]
    leaves: tuple[float, float, float, float]

    def value(self, x: list[float]) -> float:
        side = int(x[self.root[0]] > self.root[1])
        f, t = self.sides[side]
        return self.leaves[2 * side + int(x[f] > t)]

    def column(self, x: list[Column]) -> Column:
        def leaf(side: int) -> Column:
            f, t = self.sides[side]
            return F.when(x[f] > t, self.leaves[2 * side + 1]).otherwise(self.leaves[2 * side])

        return F.when(x[self.root[0]] > self.root[1], leaf(1)).otherwise(leaf(0))


@dataclass(frozen=True)
class Model:
    trees: tuple[Tree, ...]
    prior: float
    thresholds: tuple[float, ...]  # on the log odds, by generator

    def score(self, x: list[float]) -> float:
        return self.prior + sum(t.value(x) for t in self.trees)

    def column(self, x: list[Column]) -> Column:
        return functools.reduce(lambda a, b: a + b, [t.column(x) for t in self.trees], F.lit(self.prior))


def best_split(rows: set[int], x: list[list[float]], g: list[float], h: list[float], orders: list[list[int]]) -> tuple[int, float]:
    """Feature and threshold with the largest gain; (0, inf) if none splits the rows. ``orders`` sorts all rows by each feature."""
    best, at = 0.0, (0, math.inf)
    gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
    for f, order in enumerate(orders):
        lg = lh = 0.0
        a = -1
        for b in order:
            if b not in rows:
                continue
            if a >= 0:
                lg, lh = lg + g[a], lh + h[a]
                if x[a][f] != x[b][f]:
                    gain = lg * lg / (lh + 1) + (gs - lg) ** 2 / (hs - lh + 1) - gs * gs / (hs + 1)
                    if gain > best + 1e-9:
                        best, at = gain, (f, (x[a][f] + x[b][f]) / 2)
            a = b
    return at


def boost(x: list[list[float]], y: list[int], rounds: int = 40, rate: float = 0.4) -> tuple[tuple[Tree, ...], float]:
    """Gradient boosting of depth-two trees for the logistic loss, with Newton leaves."""
    prior = math.log((sum(y) + 1) / (len(y) - sum(y) + 1))
    score, trees = [prior] * len(y), []
    orders = [sorted(range(len(y)), key=lambda i, f=f: x[i][f]) for f in range(len(x[0]))]
    finite = lambda cut: (cut[0], 1e18 if math.isinf(cut[1]) else cut[1])
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [b - a for a, b in zip(p, y)], [a * (1 - a) for a in p]
        root = finite(best_split(set(range(len(y))), x, g, h, orders))
        parts = [{i for i in range(len(y)) if (x[i][root[0]] > root[1]) == bool(s)} for s in (0, 1)]
        sides = tuple(finite(best_split(r, x, g, h, orders)) for r in parts)
        cells: list[list[int]] = [[], [], [], []]
        for s in (0, 1):
            for i in sorted(parts[s]):
                cells[2 * s + int(x[i][sides[s][0]] > sides[s][1])].append(i)
        leaves = tuple(rate * sum(g[i] for i in c) / (sum(h[i] for i in c) + 1) for c in cells)
        trees.append(Tree(root, sides, leaves))
        score = [s + trees[-1].value(r) for s, r in zip(score, x)]
    return tuple(trees), prior


def calibrated(scores: list[float], y: list[int], precision: float) -> float:
    """The lowest threshold that reaches the precision on held-out rows at it and above; half way to the next row below."""
    best, hits = math.inf, 0
    ranked = sorted(zip(scores, y), reverse=True)
    for n, (s, t) in enumerate(ranked, 1):
        hits += t
        if hits >= precision * n and (n == len(ranked) or ranked[n][0] < s):
            best = (s + ranked[n][0]) / 2 if n < len(ranked) else s
    return best


def examples(n: int = 2700, seed: int = 7) -> list[dict]:
    """Labelled candidates made up by rule, as many for each generator: real formats in their contexts, and look-alikes in tables, sums, codes and names."""
    r = random.Random(seed)
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    d = lambda k: some("0123456789", k)
    w = lambda: some("abcdefghinorstu", r.randint(2, 8))
    mixed = lambda k: some("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k)
    hexes = lambda k: some("0123456789abcdef", k)
    cue = lambda xs: f"{w()} {w()} {r.choice(xs)}{r.choice([' ', ': ', ' is ', ' at '])}"
    plain = lambda: r.choice([f"{w()} {w()} ", f"{w()}, ", f"{w()}. "])
    title = lambda: w().capitalize()

    def iban(good: bool) -> str:
        country, rest = some("ABDEFGILNPST", 2), d(r.randint(11, 20))
        number = int("".join(str(int(c, 36)) for c in rest + country) + "00")
        check = f"{98 - number % 97 if good else r.choice([k for k in range(2, 99) if k != 98 - number % 97]):02d}"
        v = country + check + rest
        return " ".join(v[i : i + 4] for i in range(0, len(v), 4)) if r.random() < 0.5 else v

    def one(kind: str, good: bool) -> tuple[str, str]:
        if kind == "masked":
            at = r.choice(["(at)", "[at]", " (at) ", " [at] ", "{at}"])
            if good:
                return f"{w()}{r.choice(['', '.', '_'])}{w()}{at}{w()}{r.choice([' [dot] ', '(dot)', '.', ' (dot) '])}{r.choice(['com', 'org', 'net', 'io', 'de'])}", r.choice([plain(), cue(["mail", "write", "contact"])])
            return f"{r.choice(['f', 'x1', 'T'])}(at){d(1)}.{d(2)}", f"{w()} {d(2)} "
        if kind == "local":
            area = d(3)
            if good:
                shape = r.random()
                if shape < 0.5:
                    return f"({area}) {d(3)}-{d(4)}", r.choice([plain(), cue(["call", "phone", "tel", "number"])])
                return r.choice([f"{area}-{d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}", f"{area} {d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}"]), cue(["call", "phone", "tel", "fax", "mobile", "contact", "number"])
            return r.choice([f"{d(4)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(2)} {d(4)} {d(4)}", f"{d(3)} {d(3)} {d(4)}", f"({d(2)}) {d(3)} {d(3)}"]), r.choice([f"{w()} {d(3)} ", plain(), f"{w()}$", "table | "])
        if kind == "number":
            return f"{d(3)}-{d(2)}-{d(4)}", cue(["ssn", "social", "id", "security"]) if good else r.choice([plain(), f"{w()}#", "part ", "order ", f"{w()} no "])
        if kind == "token":
            if good:
                v = r.choice([hexes(32), hexes(40), hexes(64), mixed(r.randint(18, 44)), "sk_live_" + mixed(24), "ghp_" + mixed(36), "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), mixed(20) + "/" + mixed(19)])
                name = r.choice(["token", "secret", "api_key", "apikey", "access_token", "key", "auth", "credential"])
                return v, r.choice([f'{w()} {name} = "', f"{w()} {name}={r.choice(['', chr(34)])}", f"{w()}\n{name}: ", "Authorization: Bearer ", f"{w()} {name} "])
            v = r.choice([lambda: "-".join(w() for _ in range(5)) + d(1), lambda: "_".join(w() for _ in range(4)) + d(2), lambda: w() * 4 + d(1), lambda: d(r.randint(16, 30)), lambda: hexes(40), lambda: hexes(64), lambda: "/".join(w() for _ in range(5)) + d(4), lambda: "-" * 18 + d(1), lambda: "=" * r.randint(16, 30) + d(1), lambda: f"{d(4)}-{d(2)}-{d(2)}-{w()}-{w()}"])()
            return v, r.choice([plain(), f"{w()} ", "commit ", "sha256: ", "checksum ", "http://", "/", "see "])
        if kind == "password":
            left = f"{w()} {r.choice(['password', 'Password', 'passwd', 'pwd', 'passphrase', 'secret'])}{r.choice([': ', '=', ' = ', ': ' + chr(34)])}"
            if good:
                return r.choice([w() + d(r.randint(2, 4)), mixed(r.randint(8, 14)), title() + d(2) + r.choice("!#$%&*?"), w() + r.choice("!#$%&*?") + w() + d(1), d(6)]), left
            return r.choice(["required", "none", "null", "must", "should", "****", "xxxx", "......", "string", "your-password", "[hidden]", "{password}", "$PASSWORD", "true", "optional", w() + "."]), left
        if kind == "iban":
            return iban(good), r.choice([plain(), cue(["iban", "account", "konto"])])
        if kind == "ipv6":
            if good:
                k = r.randint(3, 6)
                return r.choice([":".join(hexes(4) for _ in range(8)), ":".join(hexes(r.randint(2, 4)) for _ in range(k)) + "::" + hexes(r.randint(1, 4))]), r.choice([plain(), cue(["host", "address", "from"])])
            return r.choice([f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(2)}:{d(2)}", f"{d(1)}:{d(1)}:{d(1)}", ":".join(d(2) for _ in range(4)), f"{d(3)}:{d(2)}:{d(1)}"]), plain()
        if kind == "person":
            left = f"{w()} {r.choice(['name is ', 'Name: ', 'name: ', 'named '])}"
            return (" ".join(title() for _ in range(r.choice([2, 2, 3]))), left) if good else (title(), left)
        name = " ".join(title() for _ in range(r.randint(1, 2)))
        street = f"{r.randint(1, 1999)} {name} {r.choice(STREETS.split('|'))}"
        return (street, r.choice([plain(), cue(["address", "live", "home", "ship"])])) if good else (f"{r.choice([1, 2, 3])} {title()} {title()} {title()} {r.choice(['Way', 'Place', 'Court'])}", f"{w()} {d(2)} ")

    out = []
    names = list(GENERATORS)
    for i in range(n):
        kind, good = names[i % len(names)], r.random() < 0.5
        value, left = one(kind, good)
        right = r.choice([" ", ".", ",", "", '"', ")", "\n"]) if good or r.random() < 0.6 else r.choice(["#", "x", "$", "|", "/"])
        out.append({"generator": i % len(names), "value": value, "left": left[-32:], "right": right, "y": int(good)})
    return out


@functools.lru_cache(maxsize=4)
def _fit(rows: tuple[tuple[float, ...], ...], precision: float) -> Model:
    x, y = [list(r[:-1]) for r in rows], [int(r[-1]) for r in rows]
    held = [i // len(GENERATORS) % 3 == 0 for i in range(len(y))]
    trees, prior = boost([a for a, o in zip(x, held) if not o], [b for b, o in zip(y, held) if not o])
    scores = [prior + sum(t.value(a) for t in trees) for a in x]
    own = lambda k: [i for i, o in enumerate(held) if o and x[i][0] == k]
    return Model(trees, prior, tuple(min(1e9, calibrated([scores[i] for i in own(k)], [y[i] for i in own(k)], precision)) for k in range(len(GENERATORS))))


def fit(spark: SparkSession, n: int = 2700, precision: float = 0.99) -> Model:
    """Fits the trees on ``n`` made-up candidates, the bound of what comes to the driver, and calibrates each generator's threshold on a third of them.

    Their features come from the same expressions that are applied to texts.
    """
    rows = F.explode(F.from_json(F.lit(json.dumps(examples(n))), "array<struct<generator:int,value:string,left:string,right:string,y:int>>"))
    d = spark.range(1).select(rows.alias("r")).select("r.*")
    x = features(F.col("generator"), F.col("value"), F.col("left"), F.col("right"))
    made = d.select(*[c.cast("double").alias(k) for k, c in x.items()], F.col("y").alias("label")).collect()
    return _fit(tuple(tuple(r) for r in made), precision)


def numbered(found: Column, kind: str) -> Column:
    """Spans as start, the kind's number and end."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """All base spans, as start, kind's number and end, in order."""

    def of(kind: str) -> Column:
        return numbered(F.filter(spans(text, BASE[kind], NEEDS[kind]), lambda s: valid(kind, s["value"])), kind)

    return F.array_sort(F.concat(*[of(k) for k in BASE]))


def candidates(text: Column) -> Column:
    """What the generators propose, with the generator's number and the kind's."""

    def given(k: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), F.lit(k).alias("generator"), s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right"))

    each = [F.transform(spans(text, pattern, NEEDS[name]), given(k, kind)) for k, (name, (kind, pattern)) in enumerate(GENERATORS.items())]
    return F.concat(*each)


def extra_spans(text: Column, base: Column, model: Model) -> Column:
    """Spans that the generators propose and the trees accept by their generator's threshold, without those that touch a base span.

    Of overlapping ones the best by margin over its threshold stays, then the best of those that touch none so far.
    """
    threshold = lambda s: F.element_at(F.array(*[F.lit(float(t)) for t in model.thresholds]), s["generator"] + 1)

    def margin(s: Column) -> Column:
        x = list(features(s["generator"], s["value"], s["left"], s["right"]).values())
        return let(F.array(*[c.cast("double") for c in x]), lambda a: model.column([a[i] for i in range(len(x))])) - threshold(s)

    touch = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    span = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))

    def best(found: Column) -> Column:
        ranked = F.array_sort(F.transform(found, lambda s: F.struct((-s["margin"]).alias("cost"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
        none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
        kept = F.aggregate(ranked, none, lambda acc, s: F.when(F.exists(acc, lambda a: touch(a, s)), acc).otherwise(F.array_append(acc, span(s))))
        return F.array_sort(kept)

    def apart(found: Column) -> Column:
        crossing = F.exists(F.sequence(F.lit(1), F.size(found) - 1), lambda i: F.get(found, i - 1)["end"] > F.get(found, i)["start"])
        return F.when(F.size(found) < 2, F.transform(found, span)).when(crossing, best(found)).otherwise(F.transform(found, span))

    def accepted(found: Column) -> Column:
        free = F.filter(found, lambda s: ~F.exists(base, lambda b: touch(b, s)))
        scored = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), margin(s).alias("margin")))
        return let(F.array_sort(F.filter(scored, lambda s: s["margin"] >= 0)), apart)

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return let(candidates(text), lambda found: F.when(F.size(found) == 0, none).otherwise(accepted(found)))


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def marked(docs: DataFrame, model: Model | None, text: str) -> DataFrame:
    """``row`` with the whole row, ``t`` with its text, and ``base`` and ``spans``."""
    model = model or fit(docs.sparkSession)
    d = docs.select(packed(docs).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumn("base", base_spans(F.col("t")))
    d = d.withColumn("extra", extra_spans(F.col("t"), F.col("base"), model))
    return d.withColumn("spans", F.when(F.size("extra") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "extra"))))


def find_pii(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``spans``, arrays of start, kind and end (code points) in order; a null text has none.

    ``spans`` holds every base span and what the trees accept beside them. Columns
    of the input stay as they are; where one has such a name, the new column gets
    an underscore. Repeated rows are read one by one; an empty table stays empty.
    """
    base, every = fresh(docs.columns, "base", "spans")
    return marked(docs, model, text).select("row.*", F.col("base").alias(base), F.col("spans").alias(every))


def redact(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; of overlapping spans the first counts. Other columns stay, whatever their names."""
    d = marked(docs, model, text)
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(F.col("t"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.get(names, s["kind"]))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.array_append(acc["out"], piece).alias("out"))
        )

    done = F.aggregate("spans", start, step)
    tail = let(done, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("t"), (a["at"] + 1).cast("int"), F.length("t"))))
    clean = F.when(F.size("spans") == 0, F.col(f"row.`{text}`")).otherwise(tail)
    return d.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def pii(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of base spans by kind, their digest, all spans, and how many the method found beside the base ones.

    A null text is empty; columns beyond doc_id and text are ignored; an empty table gives an empty result.
    """
    d = marked(docs.select("doc_id", "text"), None, "text")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    more = (F.size("spans").cast("long").alias("n_spans"), F.size("extra").cast("long").alias("n_found"))
    return d.select("row.doc_id", *[count(k) for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *more)
