"""The pipeline and the license scan against plain re-computations of the same rules."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from quillon.llm import decontam, jaccard, licenses, queries
from tests.conftest import SF, canonical
from tests.llm.test_queries import brute_components, brute_quality

SPACE = " \t\n\x0b\x0c\r"


def kept_by_quality(t):
    words, chars, symbols, dup, repeats = brute_quality(t)
    return not (words < 10 or 100 * repeats > 20 * words or 4 * dup > words or chars > 40 * words or 100 * symbols > 6 * chars)


def without_shared_lines(docs):
    """Rows (id, text, source) after line dedup: lines on ten sources or more stay in their first place only."""
    sites, first = {}, {}
    for i, t, s in docs:
        for n, line in enumerate(t.split("\n")):
            k = line.strip(SPACE)
            if k:
                sites.setdefault(k, set()).add(s or "")
                at = (len(str(i)), str(i), n)
                first[k] = min(first.get(k, at), at)
    out = []
    for i, t, s in docs:
        lines = t.split("\n")
        left = [x for n, x in enumerate(lines) if len(sites.get(x.strip(SPACE), ())) < 10 or first[x.strip(SPACE)] == (len(str(i)), str(i), n)]
        text = "\n".join(left)
        if len(left) == len(lines) or text.strip(SPACE):
            out.append((i, text, s))
    return out


def clean_of(docs, items):
    words = [w for w in (decontam.tokens(decontam.as_points(t)) for t in items) if len(w)]
    out = []
    for i, t, s in docs:
        h = decontam.tokens(decontam.as_points(t))
        if not any(decontam.edit_distance(w, h) <= decontam.edits_allowed(len(w)) for w in words):
            out.append((i, t, s))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()[:12]
    base = [x["text"] for x in pq.read_table(f"{SF}/documents.parquet").to_pylist() if x["text"] and 60 < len(x["text"].split()) < 250][:40]
    docs = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    for k in range(14):  # a line on many sources, with a text of its own
        docs.append((100 + k, "A line that every site has in its menu\n" + " ".join(f"own{k}w{j}" for j in range(30 + k)), f"site{k}"))
    for k, t in enumerate(base[:8]):  # near copies: some above the threshold, some under it
        w = t.split()
        for _ in range((0, 1, 3, 9)[k % 4]):
            w[r.randrange(len(w))] = f"changed{r.randrange(99)}"
        docs.append((200 + k, " ".join(w), "s1"))
    for k, item in enumerate(bench):  # passages of the benchmark, whole, edited a little, edited too much
        w = item["text"].split()
        for j in range((0, len(w) // 8, len(w) // 2)[k % 3]):
            w[(j * 2) % len(w)] = f"other{j}"
        docs.append((300 + k, " ".join(base[k % 9].split()[:20]) + f" mark{k} " + " ".join(w) + " " + " ".join(f"end{k}x{j}" for j in range(20)), "s2"))
    docs += [(400, None, "s1"), (401, "", None), (402, "too short", "s1"), (403, "# $ % & | < > * " * 20, "s3"), (404, "again and again we say it " * 12, None), (405, " ".join(f"w{j}" for j in range(40)), None)]
    table = pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": [d[1] for d in docs], "lang": ["en"] * len(docs), "source": [d[2] for d in docs], "n_chars": pa.array([len(d[1] or "") for d in docs], pa.int64())})
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(bench), tmp_path / "benchmark.parquet")

    left = [d for d in docs if kept_by_quality(d[1])]
    left = without_shared_lines(left)
    comp = brute_components([(i, t) for i, t, _ in left], jaccard.Join(5, 8, 10))
    left = [d for d in left if comp[d[0]][0] == 0 or comp[d[0]][1] == d[0]]
    before = len(left)
    left = clean_of(left, [x["text"] for x in bench])
    assert 0 < before - len(left) < 12 and 402 not in {d[0] for d in left}
    c = duckdb.connect()
    c.register("kept", pd.DataFrame(left, columns=["doc_id", "text", "source"]))
    c.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM kept")
    want = c.execute(f"SELECT doc_id, source, size, source_size, target, taken FROM ({queries.ORACLE_SQL['op7_source_mixing']}) JOIN (SELECT doc_id AS d, source FROM documents) ON doc_id = d").fetchall()
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert canonical(got) == canonical(want) and len(got) == len(left)


def test_license_scan_against_every_window():
    r = random.Random(9)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    seen = set()
    for _ in range(250):
        t = [r.choice("abcdefgh") * 3 for _ in range(r.randint(5, 9))]
        text = [r.choice("abcdefghxyz") * 3 for _ in range(r.randint(8, 30))]
        if r.random() < 0.6:
            at, x = r.randrange(len(text)), list(t)
            for _ in range(r.randint(0, 2)):
                x.insert(r.randrange(len(x)), r.choice("axz") * 3)
            text[at:at] = x
        s = licenses.Scanner({"T": " ".join(t)})
        need, span = s.need["T"], 2 * len(t)
        holds = any(lcs(text[k : k + span], t) >= need for k in range(len(text)))
        found = s.scan(" ".join(text))
        assert bool(found) == holds
        for _, share, a, z in found:
            assert z - a <= span and lcs(text[a:z], t) >= share * len(t) - 1e-9 and share * len(t) >= need - 1e-9
        seen.add(holds)
    assert seen == {True, False}
