"""Filter audit, toxicity and whitening against plain versions, and awkward rows."""

import random
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from perfsnap.llm import filter_audit, registry, toxicity, whitening

SF = "/root/testdata/sf0.01"


# ---- filter audit ----------------------------------------------------------


def test_fair_shares_are_means_over_orders():
    rnd = random.Random(5)
    for n in (1, 2, 3, 5):
        value = [0] + [rnd.randrange(1000) for _ in range(2**n - 1)]
        want = [Fraction(0)] * n
        orders = list(permutations(range(n)))
        for order in orders:
            before = 0
            for i in order:
                want[i] += Fraction(value[before | 1 << i] - value[before], len(orders))
                before |= 1 << i
        assert filter_audit.fair_shares(value, n) == want


def plain_audit(rows, labels):
    """Every order run over every document."""
    first, good, toxic = {}, set(), set()
    for i, text, _ in rows:
        first[text or ""] = min(first.get(text or "", i), i)
    for i, q, t in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    fails = {}
    for i, text, _ in rows:
        t = text or ""
        w = t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        w = [x for x in w if x]
        fails[i] = {f for f, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i > first[t])) if bad}
    out = set()
    for part in {s or "" for _, _, s in rows}:
        ids = [i for i, _, s in rows if (s or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = set(ids)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if f in fails[i]}
                bad = {i for i in ids if f in fails[i]}
                left_before, left = left, left - gone
                share[f] += len(gone)
                steps.append((part, order, step, len(left), len(gone), len(bad - left_before), sum(fails[i] == {f} for i in ids), len(gone & good), len(gone & toxic), f))
        out |= {(*s[:-1], share[s[-1]]) for s in steps}
    return out


def test_audit_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None), (2, "", "a"), (3, long, "a"), (4, long, "b"), (5, long, "a"), (6, "A B C # d", "b"), (7, "x " * 70, "a"), (8, long + "\x0b\x0cZ q", ""), (9, " \t\n", "a"),
            (10, "very " * 200_000, "b"), (11, long + " $", "c")]
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (4, None, 1), (99, 1, 1), (None, 1, 1), (5, 1, None)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows + rows[:3]] + [(None, "lost", "a", "x", 1)], "doc_id long, text string, source string, mask string, part int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r) for r in filter_audit.audit(docs, known).collect()}
    assert got == plain_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), known).count() == 0
    bare = filter_audit.audit(docs, known.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(bare) == (0, 0)


# ---- toxicity --------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_match(terms, word):
    near = lambda t, s, w: distance(t, w) if distance(t, w) <= toxicity.edits_allowed(t, s) else None
    whole = [(d, -len(t), t) for t, s in terms if not s and (d := near(t, s, word)) is not None]
    if whole:
        return min(whole)[2], min(whole)[0]
    begun = [(d, -len(t), t) for t, s in terms if s for n in range(1, len(word) + 1) if (d := near(t, s, word[:n])) is not None]
    return (min(begun)[2] + "*", min(begun)[0]) if begun else None


def test_automaton_finds_what_edit_distance_finds():
    rnd = random.Random(3)
    word = lambda low, high: "".join(rnd.choice("abc") for _ in range(rnd.randint(low, high)))
    for most in (200_000, 3):  # few states: forgotten again and again
        terms = sorted({(word(3, 11), rnd.random() < 0.3) for _ in range(25)})
        automaton = toxicity.Automaton(terms, most)
        for _ in range(1500):
            w = word(1, 13)
            assert automaton.match(w) == plain_match(terms, w), (terms, w)
    assert toxicity.Automaton([]).match("any") is None


@pytest.fixture(scope="module")
def insults(spark):
    """Texts that are toxic for ``zorkface`` and words beginning with ``blimp``, but not where they quote."""
    rnd = random.Random(11)
    plain = ["".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(2, 9))) for _ in range(600)]
    some = lambda n: " ".join(rnd.choice(plain) for _ in range(n))
    rows = []
    for i in range(900):
        if i % 5 == 0:
            bad = rnd.choice(["zorkface", "blimp" + rnd.choice(plain), "zorkfce"])
            rows.append((i, f"{some(8)} {bad} {some(8)}", 1))
        elif i % 450 == 1:
            rows.append((i, f'{some(8)} the word "zorkface" {some(8)}', 0))
        else:
            rows.append((i, some(20), 0))
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))


def test_learned_terms_and_context(spark, insults):
    assert ("zorkface", False) in insults.terms and ("blimp", True) in insults.terms
    texts = {1: "you zorkface go home", 2: "ZORKFACE!", 3: 'he said "zorkface" and the word is an insult', 4: "nothing of the kind", 5: None, 6: "", 7: "zorkfase is near",
             8: "blimpish folk", 9: "zebra " * 300_000, 10: "zebra " * 300_000 + "zorkface", 11: "you zorkface go home"}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(1, "you zorkface go home", 2), (None, "zorkface", 1)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, insults).collect()}
    assert sorted(got) == sorted(texts)
    assert {i for i, r in got.items() if r["predicted"] == 1} == {1, 2, 7, 8, 10, 11}
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == (r["predicted"] == 1) for r in got.values())
    assert got[1]["score"] == got[11]["score"] and got[5]["score"] == got[6]["score"] == got[4]["score"]
    assert got[7]["terms"] == ["zorkface~zorkfase"]
    assert toxicity.score(docs.limit(0), insults).count() == 0


def test_no_labels_no_terms(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, toxic string")
    for labels in ([], [(1, 0, 1)], [(1, 0, None), (2, 0, 0)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        model = toxicity.fit(toxicity.labelled(docs, known))
        assert model.terms == [] and {r["predicted"] for r in toxicity.score(docs, model).collect()} == {0}


def test_held_out_texts(spark):
    labels = registry.table(spark, SF, "labels")
    rows = registry.QUERIES["op12_toxicity"](spark, SF).join(labels, "doc_id").join(registry.table(spark, SF, "documents").where("lang = 'en'").select("doc_id"), "doc_id")
    wrong, n = rows.where("held_out").selectExpr("sum(int(predicted <> toxic))", "count(*)").first()
    assert n > 40 and wrong <= 0.05 * n


# ---- whitening -------------------------------------------------------------


def plain_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, dtype="float64")) + 1_000_000
    c = x - x.mean(axis=0)
    e, axes = np.linalg.eigh(c.T @ c / len(x))
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return e / (c * c).sum() * len(x), c @ axes / np.sqrt(e)


def test_whitening_as_by_eigenvectors(spark):
    random_ = np.random.default_rng(1)
    for n, d, k in ((300, 12, 5), (700, 40, 3)):  # the second one ends before all steps are done
        m = random_.standard_normal((n, d)) * np.linspace(4, 0.5, d)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
        rows = whitening.whiten(spark, df, k).orderBy("vec_id", "component").collect()
        explained, want = plain_whitening(m, k)
        got = np.array([r["whitened"] for r in rows]).reshape(n, k)
        assert np.allclose(got * np.sign((got * want).sum(axis=0)), want, atol=1e-8)
        assert np.allclose([r["explained"] for r in rows[:k]], explained, rtol=1e-10)
        assert rows[0]["identity_error"] < 1e-10 and {r["n"] for r in rows} == {n}
        x = [[int(v) for v in r] for r in np.floor(64 * m) + 1_000_000]
        sums = [sum(c) for c in zip(*x)]
        assert [r["deviation"] for r in rows[::k]] == [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x]


def test_equal_variances_are_all_found(spark):
    rows = [(2 * i + s, [float((2 * s - 1) * (j == i)) for j in range(6)]) for i in range(6) for s in (0, 1)]
    got = whitening.whiten(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got.agg({"component": "max", "identity_error": "max"}).first()[0] == 6
    assert all(abs(r["explained"] - 1 / 6) < 1e-9 and r["identity_error"] < 1e-9 for r in got.collect())


def test_whitening_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 2), (6, [-1.0, 2.0], 1), (6, [-1.0, 2.0], 1), (None, [3.0, 2.0], 1), (7, [], 1), (8, [-inf, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    got = whitening.whiten(spark, df).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == [(0, 1, 4), (1, 1, 4), (6, 1, 4), (6, 1, 4)]
    assert all(r["identity_error"] < 1e-9 and abs(r["explained"] - 1) < 1e-9 for r in got)
    assert whitening.whiten(spark, df.limit(0)).count() == 0
    assert whitening.whiten(spark, df.where("vec_id = 1")).count() == 0
    large = spark.createDataFrame([(1, [3e13, 0.0]), (2, [3e13 + 1, 1.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(spark, large).collect()} == {2 * 64**2}
    with pytest.raises(Exception, match="unequal length"):
        whitening.whiten(spark, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="beyond 2"):
        whitening.whiten(spark, spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>"))
