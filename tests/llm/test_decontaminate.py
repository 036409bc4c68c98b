import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest
from compare import check
from test_near_dup import thue_morse

from foliant.llm import decontaminate, queries


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for k, t in items:
        w = words(t)
        m = min(8, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(k))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i in range(len(w)):
            for m in range(1, 9):
                if len(w) >= i + m and tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def made():
    r = random.Random(7)
    v = ["Alpha", "beta", "é", "Ünder", "x1", "delta", "42"] + [f"w{k}" for k in range(30)]
    items = [(k, " ".join(r.choice(v) for _ in range(r.choice((1, 3, 7, 8, 9, 30))))) for k in range(1, 25)] + [(90, None), (91, "--"), (92, "beta beta beta beta beta beta beta beta beta")]
    docs = []
    for k in range(80):
        w = [r.choice(v) for _ in range(r.choice((0, 2, 50, 400)))]
        for _ in range(r.choice((0, 1, 3))):
            at = r.randrange(len(w) + 1)
            w[at:at] = words(r.choice(items)[1])[: r.choice((7, 8, 40))]
        docs.append((k, r.choice((" ", ", ", "\n")).join(w)))
    docs += [(100, None), (101, ""), (102, "beta " * 300), (103, ("zz " * 5000) + (items[5][1]))]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return decontaminate.matches(d, b), d, b


def test_against_brute_force(spark, monkeypatch):
    docs, items = made()
    want = brute(docs, items)
    for size in (8 << 20, 300):  # one block of items, and several passes
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        found, d, b = run(spark, docs, items)
        rows = {r.doc_id: r for r in found.collect()}
        texts, known = dict(docs), {str(k): words(t) for k, t in items}
        for k, r in rows.items():
            assert r["items"] == want[k][2]
            assert len({p for h in r.hits for p in range(h.start, h.start + h.length)}) == want[k][1]
            assert {p for h in r.hits for p in range(h.start, h.start + h.length)} <= {p for s in r.spans for p in range(s.start, s.start + s.length)}
            for s in r.spans:  # each is a verbatim match, and goes on in no item
                assert words(texts[k])[s.start : s.start + s.length] == known[s.item][s.place : s.place + s.length]
        report = {r.doc_id: r for r in decontaminate.report(found).collect()}
        assert {k: (r.n_words, r.n_hit, r.n_items, r.contaminated) for k, r in report.items()} == {k: (n, h, len(i), len(i) >= 2) for k, (n, h, i) in want.items()}
        assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == sorted(k for k, v in want.items() if not v[2])


def test_long_items_only(spark):
    """No window is shorter than 8, so most words of the documents are no places of the suffix array."""
    r = random.Random(11)
    v = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(r.choice(v) for _ in range(r.randrange(8, 40)))) for k in range(40)]
    docs = []
    for k in range(200):
        w = [r.choice([*v, "zz", "yy"]) for _ in range(r.randrange(600))]
        if k % 3 == 0:
            part = words(r.choice(items)[1])
            at, first = r.randrange(len(w) + 1), r.randrange(len(part) - 7)
            w[at:at] = part[first : first + r.randrange(7, 12)]
        docs.append((k, " ".join(w)))
    want = brute(docs, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.report(run(spark, docs, items)[0]).collect()}
    assert got == {k: (n, h, len(i)) for k, (n, h, i) in want.items()}


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(5)
    words_ = np.concatenate((rng.integers(0, 4, 3000), np.zeros(decontaminate.WINDOW, np.int64)))
    places = np.flatnonzero((words_[:-8] > 0) & (rng.random(3000) < 0.4))
    order = decontaminate.suffix_array(words_, places)
    keys = []
    for p in order.tolist():
        window = words_[p : p + 8].tolist()
        keys.append(window[: window.index(0)] if 0 in window else window)
    assert keys == sorted(keys) and sorted(order.tolist()) == places.tolist()


def test_longest_match(spark):
    item = " ".join(f"t{k}" for k in range(40))
    text = "a b c " + " ".join(f"t{k}" for k in range(5, 30)) + " d e"
    (r,) = run(spark, [(1, text)], [(7, item)])[0].collect()
    assert [(s.item, s.place, s.start, s.length) for s in r.spans] == [("7", 5, 3, 25)]


def test_longest_against_brute_force(spark):
    """Greedy cover: each match is the longest from its start over all items."""
    r = random.Random(3)
    v = [f"w{k}" for k in range(3)]
    items = [(k, " ".join(r.choice(v) for _ in range(r.randrange(8, 60)))) for k in range(30)]
    docs = [(k, " ".join(r.choice([*v, "zz"][: 3 + (r.random() < 0.3)]) for _ in range(200))) for k in range(30)]
    known = [words(t) for _, t in items]
    texts = {k: words(t) for k, t in docs}
    for row in run(spark, docs, items)[0].collect():
        w = texts[row.doc_id]
        for s in row.spans:
            best = max((next((n for n in range(len(w) - s.start + 1) if w[s.start : s.start + n] != x[p : p + n] or p + n > len(x)), len(w) - s.start + 1) - 1 for x in known for p in range(len(x))), default=0)
            assert s.length == best >= 8


def test_words_that_collide_in_polynomials(spark):
    a, b = thue_morse()
    (r,) = decontaminate.report(run(spark, [(1, a)], [(7, b)])[0]).collect()
    assert (r.n_hit, r.n_items) == (0, 0)
    (r,) = decontaminate.report(run(spark, [(1, a.upper())], [(7, a)])[0]).collect()
    assert (r.n_hit, r.n_items) == (1, 1)


@pytest.mark.parametrize("case", ["long run", "many items"])
def test_repetition_stays_in_memory(case):
    """One word many times over on both sides; one passage in very many items and documents. Each under 1 GB."""
    code = f"""
import resource, sys
resource.setrlimit(resource.RLIMIT_AS, (3 << 30, 3 << 30))
import pyarrow as pa
from foliant.llm.decontaminate import Index, _find
if {case!r} == "long run":
    index, texts, want = Index([("x", b"a " * 4000)]), ["a " * 32000], (1, 32000)
else:
    passage = " ".join(f"p{{k}}" for k in range(10))
    index, texts, want = Index([(str(k), passage.encode()) for k in range(20000)]), [f"x {{passage}} y"] * 1000, (20000, 10)
start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = 0
for out in _find(index, False)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])])):
    for i, h in zip(out.column("items"), out.column("hits").to_pylist()):
        assert (len(i), sum(x["length"] for x in h)) == want
        n += 1
assert n == len(texts)
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20, "over 1 GB"
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, env=os.environ | {"OPENBLAS_NUM_THREADS": "1"})


def test_an_id_counts_once(spark):
    a, b = " ".join("abcdefgh"), " ".join("ijklmnop")
    d = spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string")
    one = spark.createDataFrame([("k", a), ("k", b), (None, a)], "item_id string, text string")
    two = spark.createDataFrame([("k", a), ("l", a)], "item_id string, text string")
    assert decontaminate.clean(d, one, least_items=2).count() == 1 and decontaminate.clean(d, two, least_items=2).count() == 0
    assert decontaminate.matches(d, one).first()["items"] == ["k"]


def test_empty_tables(spark):
    found, d, b = run(spark, [(1, "x")], [(1, None)])
    assert found.collect()[0].spans == found.collect()[0].hits == [] and decontaminate.clean(d, b.limit(0)).count() == 1
    assert decontaminate.report(decontaminate.matches(d.limit(0), b)).collect() == []


def test_extra_columns_stay(spark):
    d = spark.sql("SELECT 1L AS doc_id, 'a b c d e f g h' AS text, 5 AS _items, 'q' AS id UNION ALL SELECT NULL, 'fine', NULL, NULL")
    b = spark.sql("SELECT 'k' AS item_id, 'A b c d e f g h' AS text, 1 AS id")
    assert [r.asDict() for r in decontaminate.clean(d, b).collect()] == [{"doc_id": None, "text": "fine", "_items": None, "id": None}]


def test_matches_sql(spark):
    check(spark, queries.QUERIES["op9_suffix_array_decontamination"], queries.ORACLE_SQL["op9_suffix_array_decontamination"])
