"""Main text of web pages by minimum-cut labelling of text blocks."""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Element names by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q ruby rp rt s samp small span strike strong sub sup svg time tt u var wbr img math mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mpadded mphantom semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template select option datalist annotation annotation-xml".split())
AWAY = frozenset("nav footer aside form button dialog menu fieldset legend label".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ROLES_AWAY = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS_AWAY = frozenset(
    "nav navbar navigation menu footer foot header masthead sidebar side aside rail ad ads adv advert advertisement advertising adsense banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr "
    "notice alert popup modal overlay comment comments commentlist disqus reply replies respond discussion share sharing social related recommended newsletter subscribe subscription signup login search "
    "breadcrumb breadcrumbs widget pagination pager toolbar copyright legal disclaimer form skip".split()
)
# Words that a name may have beside one of those; with any other, as in social-history, it names a part of the text.
WORDS_BESIDE = frozenset(
    "area articles background bar block body bottom box btn button buttons card center col column columns container content desktop div drawer fixed follow for form global grid group has holder icon icons inner item items label layout "
    "left link links list local main media mobile module nav open outer page panel posts primary right row secondary section service site slot small social sticky stories sub tabs text theme title toggle top unit us wide wrap wrapper with".split()
)
WORDS_MAIN = frozenset("article content main post entry story body text prose".split())

TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.I)
SPLIT_NAME = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
AWAY_BIT, MAIN_BIT, HEAD_BIT = 1, 2, 4
NAMED_BIT, OTHERS_BIT = 8, 16  # away by a word of its class or id only; by one for texts of others
WORDS_OTHERS = frozenset("ad ads advert advertisement promo sponsor sponsored sponsors comment comments commentlist disqus reply replies respond discussion related recommended".split())
HOLDS_MOST = 0.5  # an element named as away isn't if it holds more than this share of the page's prose
SCALE = 1000  # capacities are whole numbers of thousandths of a log odd


@dataclass
class Block:
    """A run of text without a block boundary inside."""

    text: str
    linked: int  # characters inside links
    flags: int
    tag: str
    parent: int  # number of the element that holds it
    group: int  # and of the one above


def names_in(value: str) -> set[str]:
    """The words of a name; those of one or two letters say nothing unless they stand for advertisements."""
    parts = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
    return {w for w in re.split(r"[^a-z]+", parts.lower()) if len(w) > 2 or w == "ad"}


@functools.lru_cache(maxsize=4096)
def flags_of(tag: str, attrs: str) -> int:
    """What an element says about the text in it: away from the article, part of it, or a heading."""
    named = 0
    flags = (AWAY_BIT if tag in AWAY else 0) | (MAIN_BIT if tag in ("article", "main") else 0) | (HEAD_BIT if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 0)
    if tag == "header":
        flags |= AWAY_BIT
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            each = [names_in(v) for v in value.split()]
            away = set().union(*[w for w in each if w & WORDS_AWAY and w <= WORDS_AWAY | WORDS_BESIDE | WORDS_MAIN])
            if away:
                named = 0 if tag in ("html", "body") else NAMED_BIT | OTHERS_BIT if away & WORDS_OTHERS else 0 if tag in ("article", "main") else named | NAMED_BIT
            elif any(w & WORDS_MAIN for w in each) and tag not in ("body", "html"):
                flags |= MAIN_BIT
        elif name == "role":
            flags |= (AWAY_BIT if value.lower() in ROLES_AWAY else 0) | (MAIN_BIT if value.lower() in ("main", "article") else 0)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            flags |= AWAY_BIT
    return flags if flags & AWAY_BIT else flags | named


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, in time linear in the page. Broken markup is read as far as it goes; nothing raises.

    Where no article stands free, elements that only a class or id names as away are
    wrappers of the page, and not away, if they hold its longest article or main
    element or most of its prose; those named for the texts of others only if that
    article holds most of it. After a tag with a quote that never closes, quotes
    no longer hide the end of a tag.
    """
    out: list[Block] = []
    inside: list[tuple[int, int]] = []  # of each block, the innermost named element and article around it
    named_above: dict[int, int] = {}  # of each named element, the one around it
    articles: dict[int, int] = {}  # of each article, the named element around it
    others: set[int] = set()
    # Name, flags with those above, number, place of the innermost element that isn't inline, and the named element and article around.
    stack: list[tuple[str, int, int, int, int, int]] = [("#root", 0, 0, 0, 0, 0)]
    open_names: Counter[str] = Counter()
    pieces: list[str] = []
    linked = links = number = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                i = stack[-1][3]
                out.append(Block(text, linked, stack[-1][1], stack[i][0], stack[i][2], stack[max(0, i - 1)][2]))
                inside.append(stack[-1][4:])
            pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text.strip())

    def close(name: str) -> None:
        nonlocal links
        while len(stack) > 1:
            top = stack.pop()[0]
            open_names[top] -= 1
            links -= top == "a"
            if top == name:
                return

    pos, end, stop, quotes = 0, len(page), page.rfind(">") + 1, True
    while pos < end:
        m = TOKEN.search(page, pos, stop) if pos < stop else None
        if m is None:
            say(page[pos:])
            break
        say(page[pos : m.start()])
        pos, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        q = QUOTED.match(page, pos, stop) if quotes else None
        quotes = q is not None
        shut = q.end() if q else page.find(">", pos) + 1
        attrs, pos = page[pos : shut - 1], shut
        if m[1]:
            if name not in INLINE:
                flush()
            if open_names[name] > 0:
                close(name)
            continue
        if name in RAW:
            if not attrs.endswith("/"):
                shut = re.compile(rf"</{re.escape(name)}\s*>|</{re.escape(name)}\s", re.I).search(page, pos)
                if name == "xmp":
                    flush()
                    pieces.append(page[pos : end if shut is None else shut.start()])
                    flush()
                pos = end if shut is None else shut.end() if shut[0].endswith(">") else page.find(">", shut.start()) + 1 or end
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if name in CLOSES_P and open_names["p"] > 0:
            close("p")
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
            close(name)
        number += 1
        own, above = flags_of(name, attrs), stack[-1][1]
        if name == "header" and above & MAIN_BIT and own == AWAY_BIT:
            own = 0  # the article's own head
        named, article = stack[-1][4:]
        if own & NAMED_BIT:
            named_above[number] = named
            named = number
            if own & OTHERS_BIT:
                others.add(number)
        elif name in ("article", "main") and not (above | own) & AWAY_BIT:
            article = number
            articles[number] = named
        own &= ~(NAMED_BIT | OTHERS_BIT)
        stack.append((name, above | own, number, stack[-1][3] if name in INLINE else len(stack), named, article))
        open_names[name] += 1
        links += name == "a"
    flush()
    if not any(named for named, _ in inside):
        return out
    prose: Counter[int] = Counter()
    total = 0
    for b, (named, article) in zip(out, inside):
        if not b.flags & AWAY_BIT:
            n = max(0, len(b.text) - b.linked)
            total += n
            prose[named] += n
            prose[-article] += n
    for k in sorted(named_above, reverse=True):  # those inside come after those around them
        prose[named_above[k]] += prose[k] if named_above[k] else 0
    wrappers: set[int] = {0}
    if not any(b.flags & MAIN_BIT and not b.flags & AWAY_BIT and not named for b, (named, _) in zip(out, inside)):
        wrappers.update(k for k in named_above if prose[k] > HOLDS_MOST * total and k not in others)
        longest = max(articles, key=lambda k: prose[-k], default=0)
        around, k = [], articles.get(longest, 0)
        while k:
            around.append(k)
            k = named_above[k]
        if others.isdisjoint(around) or prose[-longest] > HOLDS_MOST * total:
            wrappers.update(around)
    free = {0}  # named elements that are wrappers and stand in wrappers only
    for k in sorted(named_above):
        if k in wrappers and named_above[k] in free:
            free.add(k)
    for b, (named, _) in zip(out, inside):
        if named not in free:
            b.flags |= AWAY_BIT
    return out


def features(b: Block) -> list[float]:
    n = len(b.text)
    return [
        1.0,
        float(bool(b.flags & AWAY_BIT)),
        float(bool(b.flags & MAIN_BIT)),
        float(bool(b.flags & HEAD_BIT)),
        b.linked / n,
        min(math.log1p(n) / 6, 1.5),
        float(b.text[-1] in ".!?…:;\"”»"),
        float(b.tag in ("p", "blockquote", "pre")),
        float(b.tag == "li"),
    ]


def training_pages(n: int, seed: int) -> Iterator[tuple[str, list[int]]]:
    """Made-up pages from random templates, with the right label of each block."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeghilmnoprstu") for _ in range(r.randint(2, 9)))
    prose = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + "."
    link = lambda: f'<a href="/{word()}">{word()}</a>'
    for _ in range(n):
        parts, labels = [], []

        def put(markup: str, *ys: int) -> None:
            parts.append(markup)
            labels.extend(ys)

        for _ in range(r.randint(0, 2)):
            k = r.randint(2, 6)
            put(r.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="topnav">{}</ul>']).format("".join(f"<li>{link()}</li>" for _ in range(k))), *[0] * k)
        if r.random() < 0.6:
            put(r.choice(['<div class="ad">{}</div>', "<header>{}</header>", '<div class="cookie-notice">{}</div>', "<form>{}</form>", "<aside>{}</aside>"]).format(prose(3, 20)), 0)
        opening, closing = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div class="post-body">', "</div>"), ("<div>", "</div>")])
        put(f"{opening}<h1>{prose(3, 9)[:-1]}</h1>", 1)
        for _ in range(r.randint(2, 9)):
            x = r.random()
            if x < 0.8:
                put(f"<p>{prose(1, 60)}</p>", 1)
            elif x < 0.87:
                put(f"<h2>{prose(2, 6)[:-1]}</h2>", 1)
            elif x < 0.94:
                put(f"<ul><li>{prose(2, 12)}</li><li>{prose(2, 12)}</li></ul>", 1, 1)
            else:
                put(f'<div class="advert">{prose(2, 10)}</div>', 0)
        parts.append(closing)
        for _ in range(r.randint(0, 3)):
            put(r.choice(['<div class="comment">{}</div>', '<section id="comments"><p>{}</p></section>', '<div class="related">{}</div>', "<aside>{}</aside>"]).format(prose(3, 30)), 0)
        put(r.choice(["<footer>{}</footer>", '<div class="footer">{}</div>']).format("&copy; " + prose(2, 8)), 0)
        yield "".join(parts), labels


@functools.lru_cache(maxsize=1)
def classifier(pages: int = 240, seed: int = 11) -> tuple[float, ...]:
    """Logistic regression for content, fitted on ``pages`` made-up pages, which is the bound of its sample."""
    xs, ys = [], []
    for page, labels in training_pages(pages, seed):
        found = blocks_of(page)
        if len(found) == len(labels):
            xs += [features(b) for b in found]
            ys += labels
    x, y = np.array(xs), np.array(ys, float)
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 0.5 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w)


def min_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels with the least cost. A node not labelled content loses its positive gain, one labelled content pays its negative one; an edge costs its weight if its ends differ.

    Dinic's maximum flow; nodes reached from the source in the residual graph
    are content. Ties go to boilerplate.
    """
    n, source, sink = len(gain), len(gain), len(gain) + 1
    to: list[int] = []
    cap: list[int] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(u: int, v: int, c: int, back: int) -> None:
        adj[u].append(len(to))
        to.append(v)
        cap.append(c)
        adj[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            arc(source, i, g, 0)
        elif g < 0:
            arc(i, sink, -g, 0)
    for u, v, w in edges:
        arc(u, v, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if not cap[e])
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[u] < len(adj[u]):
                e = adj[u][at[u]]
                if cap[e] and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            else:
                if u == source:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(e)
            u = to[e]


def label(found: list[Block], weights: tuple[float, ...], adjacent: float = 1.0, near: float = 0.5) -> list[bool]:
    """Content or not, for every block.

    Terminal capacities are the classifier's log odds. Neighbours on the page and
    successive blocks of the same element or of the one above are tied, unless
    only one of them stands in an element that is away from the article. Groups
    of tied blocks whose odds all point one way need no flow.
    """
    gain = [round(SCALE * max(-20.0, min(20.0, sum(a * b for a, b in zip(weights, features(x)))))) for x in found]
    if all(g > 0 for g in gain) or all(g <= 0 for g in gain):
        return [g > 0 for g in gain]
    edges: Counter[tuple[int, int]] = Counter()
    last: dict[tuple[int, int], int] = {}
    for i, b in enumerate(found):
        if i and (found[i - 1].flags ^ b.flags) & AWAY_BIT == 0:
            edges[i - 1, i] += round(SCALE * adjacent)
        for key in ((0, b.parent), (1, b.group)):
            j = last.get(key)
            if j is not None and (found[j].flags ^ b.flags) & AWAY_BIT == 0:
                edges[j, i] += round(SCALE * near)
            last[key] = i
    return min_cut(gain, [(u, v, w) for (u, v), w in edges.items()])


def main_text(page: str | None, weights: tuple[float, ...] | None = None) -> str:
    """The article of a page: its content blocks in order, one space between. Empty for a null or empty page."""
    if not page:
        return ""
    found = blocks_of(page)
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, label(found, weights or classifier())) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``; further columns are ignored.

    Pages are read whole and one by one. A null page has an empty text, as has one
    without an article; nulls in the other columns stay; repeated rows give
    repeated results.
    """
    weights = classifier()
    fields = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(x, weights) if isinstance(x, str) else "" for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {fields['page_id']}, url {fields['url']}, text string, n_chars long")
