import random
from math import comb

import numpy as np
import pytest
from compare import check
from pyspark.sql import functions as F

from foliant.llm import near_dup, queries
from foliant.llm.components import components
from foliant.llm.store import Scratch, join_by_key


def sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    s = {i: sets(t) for i, t in rows}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s[i]), find(i), find(i) == i) for i in s}


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(r.choice((3, 5, 8, 40, 120)))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(r.choice((1, 2, 6))):
            c = list(b)
            for _ in range(r.choice((0, 0, 1, 3))):
                c[r.randrange(len(c))] = word()
            rows.append(" ".join(c))
    hot = [word() for _ in range(60)]  # a chain: neighbours are alike, ends are not
    for k in range(40):
        rows.append(" ".join([*hot[k // 2 :], *[word() for _ in range(k // 4)]]))
    rows += ["", None, " \t\n", "One two", "one  TWO", "x", "é " * 30, "É " * 30]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [256, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_open_pairs_are_verified(spark):
    """The leader of the bucket is unlike the rest, which are alike: the star alone would miss their links."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(100)]
    rows = [(0, " ".join(shared[:70] + [word() for _ in range(60)]))]
    rows += [(k, " ".join(shared + [word() for _ in range(k % 5)])) for k in range(1, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()} == {k: v[1] for k, v in brute(rows).items()}


def thue_morse(n=10, letters="ab"):
    """Two words of 2**n letters that every polynomial hash modulo 2**64 takes for one."""
    word = [0]
    for _ in range(n):
        word += [1 - x for x in word]
    return "".join(letters[x] for x in word), "".join(letters[1 - x] for x in word)


def test_words_that_collide_in_polynomials(spark):
    a, b = thue_morse()
    rows = [(1, a), (2, b), (3, f"p q r s {a} t u"), (4, f"p q r s {b} t u"), (5, f"p q r s {a.upper()} t u"), (6, f"{a} {b} x y z w {b} {a} x y z w")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and got[5][1] == 3 and [got[k][1] for k in (1, 2, 3, 4)] == [1, 2, 3, 4]


def test_confirming_is_exact():
    r = random.Random(4)
    for _ in range(400):
        v = [f"w{k}" for k in range(r.choice((2, 6, 200)))]
        x = [r.choice(v) for _ in range(r.randrange(60))]
        y = list(x) if r.random() < 0.7 else [r.choice(v) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            if y:
                y[r.randrange(len(y))] = r.choice(v)
        p, q = " ".join(x), "\t".join(y).upper()
        s, t = sets(p), sets(q)
        assert near_dup.confirmed(p.encode(), q.encode()) == bool(s and t and 100 * len(s & t) >= 75 * len(s | t))
    wide = " ".join(f"w{k}" for k in range(9000))  # more words than five numbers in one 64-bit number hold
    assert near_dup.confirmed(wide.encode(), (wide + " x").encode()) and not near_dup.confirmed(wide.encode(), wide[: len(wide) // 2].encode())


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, None, None), (3, "", None), (4, "a b c d e f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept, r.n_copies) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True, 3), (1, 2, 1, True, 3), (None, 2, None, False, 3), (2, 0, 2, True, 1), (3, 0, 3, True, 1), (4, 2, 1, False, 3)], key=str)
    assert sorted(r.doc_id or -1 for r in near_dup.keep_one(df).collect()) == [-1, 1, 2, 3]
    assert near_dup.near_duplicates(df.limit(0)).collect() == []
    assert near_dup.keep_one(df.limit(0)).columns == df.columns


def test_one_id_with_two_texts(spark):
    """Each row is judged by its own text: that of id 1 which copies id 0 goes, the other stays."""
    df = spark.createDataFrame([(0, "a b c d e f g"), (1, "a b c d e f g"), (1, "q r s t u v w"), (1, None), (1, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_dup.near_duplicates(df).collect())
    assert got == [(0, 0, True, 3), (1, 0, False, 3), (1, 1, True, 0), (1, 1, True, 0), (1, 1, True, 3)]
    assert sorted((r.doc_id, str(r.text)) for r in near_dup.keep_one(df).collect()) == [(0, "a b c d e f g"), (1, ""), (1, "None"), (1, "q r s t u v w")]


def test_names_and_types_of_ids(spark):
    df = spark.createDataFrame([(1, "a b", True), (2, "a b", None)], "n_shingles long, kept string, _kept boolean")
    out = near_dup.near_duplicates(df, "n_shingles", "kept")
    assert out.columns == ["n_shingles", "n_shingles_", "component_id", "n_copies", "kept"]
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1, 2, True), (2, 1, 1, 2, False)]
    assert [tuple(r) for r in near_dup.keep_one(df, "n_shingles", "kept").collect()] == [(1, "a b", True)]
    with pytest.raises(TypeError, match="integers"):
        near_dup.near_duplicates(spark.createDataFrame([("x", "a")], "doc_id string, text string"))


def test_scratch_goes(spark, tmp_path, monkeypatch):
    import os

    from foliant.llm import store

    monkeypatch.setattr(store, "shared_dir", lambda s: f"file://{tmp_path}")
    near_dup.near_duplicates(spark.createDataFrame(corpus(), "doc_id long, text string")).collect()
    (run,) = os.listdir(tmp_path)
    assert len([n for n in os.listdir(tmp_path / run) if not n.startswith(".")]) == 2  # what the result reads


def test_unlike_members_of_one_bucket(spark, monkeypatch):
    """3,000 documents that share one long passage, a few of them alike: the work of the crossing stays with members that
    meet outside the largest component, and no link is lost."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [(k, " ".join([*passage, *(word() for _ in range(60))])) for k in range(3000)]
    rows += [(5000 + k, rows[7 * k][1] + " tail") for k in range(100)]
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[5000 + k] == 7 * k for k in range(100)) and all(got[k] == k for k in range(3000))


def test_matches_sql(spark):
    check(spark, queries.QUERIES["op1_minhash_near_dedup"], queries.ORACLE_SQL["op1_minhash_near_dedup"])


def test_recall_near_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.8, held against brute force: all of 300 are found."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    while len(rows) < 600:
        x = [word() for _ in range(104)]
        y = list(x)
        for at in r.sample(range(5, 99), 3):
            y[at] = word()
        s, t = sets(" ".join(x)), sets(" ".join(y))
        if 75 <= 100 * len(s & t) / len(s | t) < 80:
            rows += [(len(rows), " ".join(x)), (len(rows) + 1, " ".join(y))]
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 for k in range(600)}


def test_pruning_rule():
    assert list(near_dup.LEAST) == sorted(near_dup.LEAST) and near_dup.posterior(near_dup.LEAST[-1] - 1, 128, 0.75) < near_dup.MISS <= near_dup.posterior(near_dup.LEAST[-1], 128, 0.75)
    rng = np.random.default_rng(1)
    left = rng.integers(0, 256, (2000, 128), dtype=np.uint8)
    right = np.where(rng.random((2000, 128)) < 0.75, left, left ^ 1)
    assert len(near_dup.surviving(left, right)[0]) >= 1998
    assert len(near_dup.surviving(left, rng.integers(0, 256, (2000, 128), dtype=np.uint8))[0]) == 0


def test_pruning_loses_no_more_than_the_bands():
    lost, at_bands = 0.0, (1 - 0.75**near_dup.ROWS) ** near_dup.BANDS
    state = {0: 1.0}  # chance of each number of matches of a pair at 0.75 that is still alive
    for least in near_dup.LEAST:
        after = {}
        for m, p in state.items():
            for k in range(near_dup.BATCH + 1):
                after[m + k] = after.get(m + k, 0.0) + p * comb(near_dup.BATCH, k) * 0.75**k * 0.25 ** (near_dup.BATCH - k)
        lost += sum(p for m, p in after.items() if m < least)
        state = {m: p for m, p in after.items() if m >= least}
    assert lost <= 5e-6 and at_bands <= 5.2e-6
    assert abs(near_dup.total_miss() - lost) < 1e-12


def test_hot_keys_are_not_dealt_out(spark):
    """A key with a third of all rows, and keys on one side only, joined as by a plain join."""
    left = spark.createDataFrame([(7 if k % 3 == 0 else k, k) for k in range(6000)] + [(9999, 1)], "key long, v long")
    right = left.groupBy("key").count().withColumnRenamed("count", "n").where("key <> 9999").selectExpr("key", "n", "key * 2 AS w")
    for how, n in (("inner", 6000), ("left", 6001)):
        out = join_by_key(left, right, "key", "n", 6001, how)
        want = left.join(right, "key", how)
        assert out.count() == n and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    few = join_by_key(left, right, "key", "n", 6001, of=F.col("key") > 7)  # the hot key is known, and not joined
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, left.join(right.where("key > 7"), "key").collect()))


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)]
    root = {n: n for p in links for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.comp for r in components(df, Scratch(spark, "t")).collect()}
    assert got == {n: find(n) for p in links for n in p if any(a != b and n in (a, b) for a, b in links)}
