"""The training-data queries against SQL, brute force, exact round trips and held-out cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, decontam, html, jaccard, licenses, lines, mixing, pii, quality, queries, suffixes
from tests.conftest import SF, held_against

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


ODD = [None, "", "   \n\t", "one", "a b c d e f g h i j k", "same line here\nsame line here\n\nother", "x" * 30000, "é😀 ü z " * 5, "\\<|im_end|>", "a b c d e " * 40]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    held_against(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name])


# 1
def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(g)
    at = {i + k for i, x in enumerate(g) if n[x] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(at)


def test_quality_on_odd_texts(spark):
    d = docs_of(spark, ODD).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1))
    for r in quality.quality(d).collect():
        want = brute_quality(ODD[r.doc_id])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality.quality(d.limit(0)).count() == 0


def test_keep_agrees_with_verdict_and_order_does_not_matter(spark):
    d = read(spark, "documents")
    kept = {r.doc_id for r in quality.quality(d).filter("kept").select("doc_id").collect()}
    assert {r.doc_id for r in quality.keep(d).select("doc_id").collect()} == kept
    rules = quality.default_rules()
    out = quality.with_metrics(d).withColumn("a", quality.cascade(rules).isNull()).withColumn("b", quality.cascade(rules[::-1]).isNull())
    assert out.filter("a <> b").count() == 0


def test_rules_are_ordered_by_rejection_per_cost():
    m = [quality.Measured(quality.Rule(n, None), s, x) for n, s, x in (("slow", 2.0, 0.2), ("none", 0.1, 0.0), ("fast", 0.1, 0.1))]
    assert [r.name for r in quality.order(m)] == ["fast", "slow", "none"]


# 2
def test_html_keeps_the_article_only():
    p = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site head</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>'
        "<article><header><h1>A &amp; B</h1></header><p><b>Bold<br>text &lt;tag&gt; goes on for a while here.<p>Second   paragraph,\n with <i>in</i>line.</p><div class='ad'>Buy now!</div><p>Short.</p></article>"
        '<aside>Related things</aside><section id="comments"><p>First comment is quite long and looks like prose.</p></section><form>Mail <input></form><footer>&copy; us</footer></body>'
    )
    assert html.main_text(p) == "A & B Bold text <tag> goes on for a while here. Second paragraph, with inline. Short."


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("around", ["<body class='has-sidebar'>{}</body>", "<html class='nav-open'><body>{}</body></html>", "<div class='content sidebar-right'>{}</div>", "<div id='page' class='social'>{}</div>", "<div id='page' class='social'><div class='with-sidebar'>{}</div></div>"])
def test_html_wrappers_named_like_boilerplate(around, tag):
    p = f"<{tag}><h1>A headline</h1>" + "".join(f"<p>Paragraph {k} goes on for a while and says something of its own about it.</p>" for k in "abcdef") + f"</{tag}>"
    away = '<div class="sidebar"><p>Other things in a list.</p></div><section id="comments"><article class="comment"><p>A comment that is long and looks like prose.</p></article></section><div class="related"><article><p>Another story starts here.</p></article></div>'
    want = " ".join(re.sub("<[^>]*>", " ", p).split())
    assert html.main_text(around.format("<nav><a href='/'>Home</a></nav>" + p + away)) == want
    if tag != "div":
        assert html.main_text(p + away.replace("looks like prose", "looks like prose " * 60)) == want


def test_html_on_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<"), (4, "u", "<p"), (5, "u", "plain text only"), (6, None, "<div " * 2000), (7, "u", "<script>never closed"), (8, "u", "<p>" + "w " * 50000), (8, "u", "<a href='x>y</a>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(0))).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert next(r for r in got if r.page_id == 1).text == ""


def test_html_on_pages(spark):
    for r in read(spark, "pages").collect():
        a = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        import html as h

        want = " ".join(h.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", a))).split())
        assert html.main_text(r.html) == want


def test_min_cut_against_all_labellings():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(1, 7)
        gain = [r.randint(-9, 9) for _ in range(n)]
        edges = [(r.randrange(n), r.randrange(n), r.randint(0, 6)) for _ in range(r.randint(0, 9))]
        edges = [(u, v, w) for u, v, w in edges if u != v]
        cost = lambda x: sum(-g if k else 0 for g, k in zip(gain, x)) + sum(w for u, v, w in edges if x[u] != x[v])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert cost(html.min_cut(gain, edges)) == best


# 3
def test_chat_round_trip_and_mask(spark):
    texts = ["\\", "<|", "<\\|", "\\\\<|im_start|>", "a\nb", None, "<|im_end|>\n<|im_start|>assistant\nx", "<\\n>"]
    rows = [(i % 2, i, r, t) for i, t in enumerate(texts) for r in ("assistant",)] + [(5, None, None, "x"), (None, 0, "us\ner<|", "y"), (5, 1, "assistant", "é😀")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit(1))
    f = chat.format_chats(chat.as_parts(c))
    back = {r.conv_id: [(t.role, t.text) for t in r.b] for r in f.select("conv_id", chat.read_back(F.col("formatted")).alias("b")).collect()}
    for conv in (0, 1):
        assert back[conv] == [("assistant", t or "") for i, t in enumerate(texts) if i % 2 == conv]
    assert back[None] == [("us\ner<|", "y")] and back[5] == [("", "x"), ("assistant", "é😀")]
    got = {r.conv_id: r for r in chat.chat(c).collect()}
    assert got[5].loss_chars == 2 and got[5].loss_sha256 == hashlib.sha256("é😀".encode()).hexdigest()
    assert got[-1].n_turns == 2 and chat.chat(c.limit(0)).count() == 1


def test_chat_parts(spark):
    p = "array(named_struct('type','text','text','see <|image|>','ref',null,'width',null,'height',null,'seconds',null,'pages',null), named_struct('type','image','text',null,'ref','a.png','width',56,'height',29,'seconds',null,'pages',null), named_struct('type','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',2.0,'pages',null))"
    t = spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, CAST({p} AS ARRAY<STRUCT<type:STRING,text:STRING,ref:STRING,width:BIGINT,height:BIGINT,seconds:DOUBLE,pages:BIGINT>>) AS parts")
    r = chat.format_chats(t).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|im_end|>\n"
    assert [(a.type, a.ref, a.position, a.tokens) for a in r.attachments] == [("image", "a.png", 0, 4), ("audio", "b.wav", 1, 50)]


# 4
def test_decontamination_recall_and_precision(spark):
    r = random.Random(8)
    items = [(x.item_id, x.text) for x in read(spark, "benchmark").collect()]
    clean = [x.text for x in read(spark, "documents").filter("length(text) between 400 and 900").limit(30).collect()]
    texts, truth = [], set()
    for i, (item, text) in enumerate(items):
        w = text.split()
        for _ in range(r.randint(0, decontam.edits_allowed(len(w)))):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 1)] = [f"zq{r.randrange(99)}"] * r.randint(0, 1)
        base = clean[i % len(clean)].split()
        texts.append(" ".join(base[:30]) + " " + " ".join(w).upper() + " " + " ".join(base[30:]))
        truth.add((i, item))
    bench = read(spark, "benchmark")
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(docs_of(spark, texts), bench).collect()}
    assert len(got & truth) >= 0.95 * len(truth)
    exact = {(i, k) for i, t in enumerate(texts) for k, x in items if x.lower() in t.lower()}
    assert exact <= got
    odd = docs_of(spark, ODD)
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.clean(odd, bench).count() == len(ODD)
    assert decontam.clean(odd, bench.limit(0)).columns == odd.columns


def test_decontamination_misses_nothing_where_samples_do_not_do(monkeypatch):
    monkeypatch.setattr(decontam, "MAX_SAMPLES", 8)  # reached at sizes that are searched fast
    r = random.Random(5)
    words = lambda n: [f"w{int(r.paretovariate(0.5)) % 20000}" for _ in range(n)]
    items = [words(r.randint(100, 300)) for _ in range(30)]
    texts = []
    for w in items:
        x = list(w)
        for _ in range(decontam.edits_allowed(len(w))):
            k = r.randrange(len(x))
            x[k : k + r.randint(0, 1)] = [f"zq{r.randrange(99)}"] * r.randint(0, 1)
        texts.append(" ".join(words(100) + x + words(100)))
    texts += [" ".join(w) for w in items] + [" ".join(words(500)) for _ in range(10)]
    index = decontam.Index(list(range(len(items))), [" ".join(w) for w in items])
    got = decontam.find_hits(texts, index)
    assert [[i for i, _ in x] for x in got] == [[i] for i in range(len(items))] * 2 + [[]] * 10
    assert all(x[0][1] == 0 for x in got[len(items) : 2 * len(items)])


def test_decontamination_of_short_items_and_scripts_without_spaces(spark):
    items = ["Quelle est?", "Zug", "北京是中华人民共和国的首都。它位于华北平原。", "東京は日本の首都です。", "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย", "北京", "?!", "", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["so, QUELLE   est - now", "Zugabe quelle", "der “Zug”", "前文" + items[2] + "後文", "前文北京是中华人民共和国的首都它位于华东平原后文", "あの" + items[3], "ก" + items[4] + "ก", "上海", "quelle", "est"]
    got = {i: set() for i in range(len(texts))}
    for x in decontam.contaminated(docs_of(spark, texts), bench).collect():
        got[x.doc_id].add((x.item_id, x.distance))
    assert list(got.values()) == [{(0, 0)}, set(), {(1, 0)}, {(2, 0), (5, 0)}, {(2, 1), (5, 0)}, {(3, 0)}, {(4, 0)}, set(), set(), set()]
    assert decontam.clean(docs_of(spark, texts), bench).count() == 4


def test_edit_distance_against_brute_force():
    import numpy as np

    r = random.Random(2)
    for _ in range(100):
        a, b = [r.randrange(4) for _ in range(r.randint(1, 7))], [r.randrange(4) for _ in range(r.randint(0, 9))]
        best = 99
        for i in range(len(b) + 1):
            for j in range(i, len(b) + 1):
                p = list(range(j - i + 1))
                for x in a:
                    q = [p[0] + 1]
                    for k, y in enumerate(b[i:j]):
                        q.append(min(p[k] + (x != y), p[k + 1] + 1, q[-1] + 1))
                    p = q
                best = min(best, p[-1])
        assert decontam.edit_distance(np.array(a, np.uint64), np.array(b, np.uint64)) == best


# 5
def test_licenses_whole_changed_repeated_and_absent(spark):
    texts = list(ODD)
    for t in licenses.TEMPLATES.values():
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append("intro words the software " + " ".join(w) + " and more text")
    texts.append(licenses.TEMPLATES["MIT-short"] + " filler words here\n" + licenses.TEMPLATES["MIT-short"])
    got = licenses.scan_licenses(docs_of(spark, texts)).collect()
    by = {i: [r.license for r in got if r.doc_id == i] for i in range(len(texts))}
    for i, name in enumerate(licenses.TEMPLATES, len(ODD)):
        assert by[i] == [name]
    assert by[len(texts) - 1] == ["MIT-short", "MIT-short"] and not any(by[i] for i in range(len(ODD)))


@pytest.mark.parametrize("gap", [0, 10, 40])
@pytest.mark.parametrize("name", [k for k, t in licenses.TEMPLATES.items() if len(licenses.words(t)) > 30])
def test_licenses_that_stand_twice(name, gap):
    w = licenses.words(licenses.TEMPLATES[name])
    damaged = w[: len(w) // 2] + ["changed"] + w[len(w) // 2 + 3 :]
    for second in (w, damaged):
        text = ["lead"] * 200 + w + ["between"] * gap + second + ["tail"] * 200
        got = [(r[0], r[2], r[3]) for r in licenses.Scanner().scan(" ".join(text))]
        at = 200 + len(w) + gap
        assert got == [(name, 200, 200 + len(w)), (name, at, at + len(second))]


def test_license_windows_against_brute_force():
    r = random.Random(6)
    for _ in range(60):
        t, x = [r.choice("abcd") for _ in range(5)], [r.choice("abcdz") for _ in range(14)]
        got = {(c, s, e) for c, s, e in licenses.windows(x, t, range(len(x)), 3)}
        lcs = {(s, e): len(licenses.word_by_word(x[s:e], t, 0, 0)) for s in range(14) for e in range(s, min(14, s + 10) + 1)}
        assert got == {(c, s, min(e for e in range(s, min(14, s + 10) + 1) if lcs[s, e] >= c)) for c in range(3, 6) for s in range(14) if lcs[s, min(14, s + 10)] >= c}


def test_patience_alignment():
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    a, b = "x the a b the c y".split(), "the a q b the c".split()
    assert [(a[i], b[j]) for i, j in licenses.align(a, b)] == [(w, w) for w in "the a b the c".split()]


# 6
def test_lines_on_odd_rows(spark):
    rows = [(i, "menu\nunique %d\n  \nmenu" % i, f"s{i}") for i in range(12)] + [(90, None, None), (91, "", "s1"), (None, "menu", "s2"), (3, "menu\nunique 3\n  \nmenu", "s3")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("gone", F.lit(1)).withColumn("site", F.lit(1))
    got = {r.doc_id: r for r in lines.dedup_lines(d).collect()}
    assert got[None].clean_text == "menu" and got[0].clean_text == "unique 0\n  "  # a null key comes first
    assert got[5].clean_text == "unique 5\n  " and got[5].n_removed == 2 and got[90].clean_text is None and got[91].n_lines == 1
    assert lines.dedup_lines(d.limit(0)).count() == 0


# 7
def test_mix_totals_and_shards(spark):
    d = read(spark, "documents").select("doc_id", "text", "source").unionByName(spark.createDataFrame([(-1, None, None), (None, "a b", "zz"), (-3, "x " * 5000, "zz")], "doc_id long, text string, source string"))
    m = mixing.mix(d)
    rows = m.collect()
    assert len(rows) == d.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(u.words for u in r.uses)
        x = by.setdefault(r.source, [0, r.target])
        x[0] += r.taken
    assert all(abs(a - b) <= 1 for a, b in by.values())
    used = mixing.mixture(d).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).count()
    assert used == 2**mixing.LEVELS
    assert sorted(map(str, mixing.mix(d).select("doc_id", "taken").collect())) == sorted(str(r) for r in m.select("doc_id", "taken").collect())
    assert mixing.mix(d.limit(0)).count() == 0


def test_hypergeometric_mean(spark):
    u = (F.col("id") + 0.5) / 1000
    x = spark.range(1000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), u).alias("x")).agg(F.avg("x").alias("m"), F.min("x").alias("a"), F.max("x").alias("b")).first()
    assert abs(x.m - 4) < 0.05 and x.a >= 0 and x.b <= 10


# 8
def brute_pii(t):
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0

    for k, (p, ok) in enumerate(
        [
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
        ]
    ):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if ok(m[0])]
    return sorted(out)


def test_pii_base_against_brute_force(spark):
    hard = ["a@b.c_d@e.f x@y.z-1.", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 +12 +1-2((3)4.567.89012", "é😀 m@y.zz 😀 1.1.1.1 " * 200, "q@" + "a." * 300]
    d = read(spark, "documents").select("doc_id", "text")
    d = d.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(ODD + hard)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in pii.pii(d).collect():
        b = brute_pii(texts[r.doc_id])
        said = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in b) for k in range(4))
        assert set(said) <= set(r.spans.split(",") if r.spans else [])


def test_pii_model_on_held_out_cases_and_redaction(spark):
    m = pii.fit(spark)
    rows = pii.examples(450, seed=99)
    d = spark.createDataFrame([(x["generator"], x["value"], x["left"], x["right"], x["y"]) for x in rows], "g int, v string, l string, r string, y int")
    score = m.column(list(pii.features(F.col("g"), F.col("v"), F.col("l"), F.col("r")).values()))
    got = d.select((score >= F.element_at(F.array(*[F.lit(float(t)) for t in m.thresholds]), F.col("g") + 1)).alias("p"), "y").collect()
    hit = [r for r in got if r.p]
    assert sum(r.y for r in hit) >= 0.97 * len(hit) and len(hit) >= 0.8 * sum(r.y for r in got)
    t = spark.createDataFrame([(1, "write a@b.co or call me: (555) 123-4567."), (2, None)], "doc_id long, text string")
    assert {r.text for r in pii.redact(t).collect()} == {"write <email> or call me: <phone>.", None}


# 9
def brute_components(texts, join):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + join.size]) for k in range(len(w) - join.size + 1)} if len(w) >= join.size else {tuple(w)} if w else set()
    par = {i: i for i in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if join.den * n >= join.num * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    par[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("join", [jaccard.Join(), jaccard.Join(5, 8, 10)])
def test_jaccard_against_brute_force(spark, join):
    r = random.Random(1)
    texts = [(r_.doc_id, r_.text) for r_ in read(spark, "documents").filter("doc_id < 60").collect()] + [(900 + i, t) for i, t in enumerate(ODD)]
    for j in range(60):
        n = r.choice([7, 9, 10, 12, 14, 18, 22, 40])
        w = [f"W{i}" for i in range(n)]
        for _ in range(r.choice([0, 1, 2])):
            w[r.choice([0, n - 1, r.randrange(n)])] = f"z{r.randrange(3)}"
        texts.append((6000 + j, " ".join(w)))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(d, join).collect()}
    want = brute_components(texts, join)
    assert got == want
    if join.size == 5:
        kept = {x.doc_id for x in jaccard.keep_one(d, join).collect()}
        assert kept == {c if n else i for i, (n, c) in want.items()}


def test_subset_and_pack_helpers():
    import numpy as np

    x = np.array([0, 5, 70000, 70000, 200000], np.uint64)
    assert (jaccard.unpack(jaccard.pack(x)) == x).all()
    s = np.arange(1, 6, dtype=np.uint64)
    assert len(set(jaccard.subset_keys(s, 3).tolist())) == 10 and len(jaccard.subset_keys(s, 5)) == 1


# 10
def test_suffixes_against_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in read(spark, "documents").filter("doc_id < 40").collect()]
    r = random.Random(1)
    base, p = texts[0][1][:1500], "".join(r.choice("abc déf") for _ in range(260))
    texts += [(901, None), (902, ""), (903, "x" * 1000), (904, "ab" * 300), (905, base + "Z" + base), (906, p), (907, "q" * 10 + p[:199]), (908, p[30:] + "tail" * 80), (909, base), (909, base), (None, base[100:700])]
    got = sorted(map(tuple, suffixes.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()), key=str)
    raw = [(i, (t or "").encode()) for i, t in texts]
    n = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = []
    for i, b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - 199):
            if n[b[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert got == sorted(want, key=str)


def test_hot_windows_equal_bucket_scan(spark):
    import numpy as np
    import pandas as pd

    r = random.Random(3)
    core = bytes(r.choice(b"abcd") for _ in range(600))
    rows = []
    for k in range(30):
        a, b = r.choice([0, 30, 100, 150]), r.choice([50, 90, 140, 200])
        left = bytes(r.choice(b"xyz") for _ in range(r.randint(0, 150 - a))) + core[300 - a : 300]
        right = core[300 : 300 + b] + bytes(r.choice(b"uvw") for _ in range(r.randint(0, 200 - b)))
        rows.append((7, k, k, left, right))
    scanned = suffixes._scan_bucket(pd.DataFrame(rows, columns=["hash", "ca", "cb", "left", "right"]))
    hot = suffixes.hot_windows(spark.createDataFrame(rows, "hash long, ca long, cb long, left binary, right binary")).toPandas()
    assert sorted(map(tuple, np.array(scanned).tolist())) == sorted(map(tuple, np.array(hot[["hash", "ca", "cb", "lo", "hi"]]).tolist()))


# pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    bench = read(spark, "benchmark").orderBy("item_id").first().text
    prose = read(spark, "documents").filter("doc_id = 0").first().text
    d = read(spark, "documents").unionByName(
        spark.createDataFrame([(7001, prose + " near copy", "en", "src1", 1), (7002, prose, "en", "src2", 1), (7003, "clean words in front of it all " + bench, "en", "src3", 1), (7004, "one of a kind text that nobody else has and nothing is wrong with it at all", "en", "src4", 1), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    ).withColumn("hits", F.lit(1))
    for name, stage in p.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", "hits"], name
    left = {r.doc_id for r in d.collect()}
    assert 7004 in left and 7003 not in left and len(left & {0, 7001, 7002}) == 1 and None not in left
    out = p.STAGES[-1][1](spark, d, SF)
    assert out.count() == len(left)
