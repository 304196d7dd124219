"""Spelling variants, toxicity and whitening against brute force and truth."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefolio.llm import spelling, toxicity, whitening
from lakefolio.llm.common import table

DATA = "/root/testdata/sf0.01"


# ---- spelling ----
def counted(rows):
    low, out = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), collections.Counter()
    for doc_id, text in rows:
        for run, n in collections.Counter(re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(low))).items():
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += n
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def forms_of(words):
    """By the letters left out: words one edit apart meet in such a string."""
    meet, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for s in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            meet[s].add(w)

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    for some in meet.values():
        for a in some:
            near[a] |= {b for b in some if b != a and b not in near[a] and apart(a, b)}
    out, best = {}, {}
    for w, n in words.items():
        top = min(near[w], key=lambda x: (-words[x], x), default=None)
        best[w] = top if top is not None and words[top] >= 2 * n else None
    for w, n in words.items():
        root = w
        while best[root] is not None:
            root = best[root]
        out[w] = (best[w], root, n, len(near[w]), words.get(best[w]))
    return out


def found(rows):
    got = rows.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def test_spelling_of_the_table(spark):
    docs = table(spark, DATA, "documents")
    want = forms_of(counted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    assert found(spelling.group_variants(docs)) == want and len(want) > 10_000
    assert max(len(w) for w in want) > 10 and any(v[1] not in (w, v[0]) for w, v in want.items())


@pytest.mark.parametrize("sizes", [{"shard_words": 7, "task_words": 40, "broadcast_bytes": 900}, {"shard_words": 50, "task_words": 5}])
def test_spelling_in_small_shards_and_rounds(spark, sizes):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abé×ÿ"), rng.integers(0, 7))): int(rng.integers(1, 9)) for _ in range(700)}
    words |= {"x" * 4000: 5, "x" * 3999: 11, "x" * 4001: 11}
    got = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), **sizes)
    want = forms_of({w: n for w, n in words.items() if len(w) < 4000 and w[:1] != "x"}) | forms_of({w: n for w, n in words.items() if w[:1] == "x"})
    for r in got.collect():
        assert r.n_near == want[r.word][3] and r.n == words[r.word]
        if r.n_near:
            assert want[r.word][0] in (None, r.form) and words[r.form] == r.form_n
    assert got.count() == len(words)


def test_spelling_of_odd_rows(spark):
    long = "qwertz" * 2000
    rows = [(1, None), (2, ""), (3, "été ÉTÉ Äpfel äpfel"), (None, "Haus hauses hauses hauses hauses"), (4, f"{long} {long} {long}"), (5, "naïve naïve NAïVE na"), (5, "naïve naïve NAïVE na")]
    rows += [(i, "hauses hausen") for i in range(100, 140)]
    docs = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], "doc_id long, text string, word string, n int, form string").repartition(3)
    got = found(spelling.group_variants(docs))
    assert got == forms_of(counted(rows)) and got[long][2] == 3 and got["naïve"][2] == 6
    assert spelling.group_variants(docs.limit(0)).count() == 0
    assert spelling.group_variants(docs.filter("doc_id = 1")).count() == 0


# ---- toxicity ----
def test_toxicity_on_held_out_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    judged = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    right = collections.Counter(judged)
    assert right[1, 1] / (right[1, 1] + right[1, 0]) > 0.75 and right[0, 1] / (right[0, 0] + right[0, 1]) < 0.02, right


def test_pairs_are_learnt_that_no_sum_of_weights_can(spark):
    rng, rows = np.random.default_rng(0), []
    for i in range(2000):
        a, b = rng.integers(0, 2, 2)
        said = [f"word{n}" for n in rng.integers(0, 40, 8)] + [("fluffy", "wretch")[a], ("garden", "foreigners")[b]]
        rows.append((i, " ".join(said), int(a != b)))  # either alone tells nothing
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert sum(y == p for y, p in held) / len(held) > 0.9


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    live = np.unique([b for w in ("grass", "grassland", "stone") for b in toxicity.buckets(w)])
    machine = toxicity.Machine(-0.3, live, rng.normal(size=len(live)), rng.normal(size=(len(live), 3)))
    at = sorted({int(machine.columns[b]) for w in ("grass", "grassland", "stone") for b in toxicity.buckets(w)})
    pairs = sum(machine.factors[i] @ machine.factors[j] for i in at for j in at if i < j)
    z = -0.3 + sum(machine.weights[i] for i in at) + pairs * toxicity.pair_share(4)
    assert abs(machine.score("Grass, GRASSLAND; stone stone unknown") - 1 / (1 + np.exp(-z))) < 1e-12


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5, True), (None, "x", 0.5, True), (2, "", 0.1, False), (3, "w " * 300_000 + "b" * 300_000, 0.1, False), (3, "again", 0.2, None)], "doc_id long, text string, score double, held_out boolean")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(3, 1), (None, 1), (1, None), (2, 7)], "doc_id long, toxic int")
    for labels in (none, one):
        got = toxicity.classify(docs, labels).collect()
        assert len(got) == 5 and len({r.score for r in got}) == 1 and all(r.held_out for r in got if r.doc_id is None)
    assert toxicity.classify(docs.limit(0), none).count() == 0


# ---- whitening ----
def brute(rows, scale=256):
    """(sums, n, deviations by vector, covariance) by plain Python integers."""
    fit = sorted({tuple(x) for x in rows})
    n, size = len(fit), len(fit[0])
    s = [sum(x[d] for x in fit) for d in range(size)]
    cov = [[(n * sum(x[a] * x[b] for x in fit) - s[a] * s[b]) / n**2 for b in range(size)] for a in range(size)]
    return n, s, np.array(cov), {x: sum((n * v - t) ** 2 for v, t in zip(x, s)) for x in fit}


def check_whitening(got, ints, components):
    n, s, cov, deviation = brute([x for _, x in ints])
    values = np.linalg.eigvalsh(cov)[::-1][:components]
    by = collections.defaultdict(dict)
    for i, x in ints:
        by[i].setdefault(tuple(x), 0)
    found = collections.defaultdict(dict)
    for r in got:
        assert r.n == n and abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9 and r.identity_error < 1e-9
        assert int(r.deviation_exact) in {deviation[x] for x in by[r.vec_id]}
        found[int(r.deviation_exact), r.vec_id][r.component] = r.whitened
    fit = {x: np.array([found[deviation[x], i][c + 1] for c in range(components)]) for i, some in by.items() for x in some}
    w = np.array(list(fit.values()))
    assert np.abs(w.mean(axis=0)).max() < 1e-9 and np.abs(w.T @ w / n - np.eye(components)).max() < 1e-9


def test_whitening_of_the_table(spark):
    vectors = table(spark, DATA, "embeddings")
    ints = [(r.vec_id, tuple(int(np.floor(256 * float(np.float32(v)))) for v in r.embedding)) for r in vectors.collect()]
    got = whitening.whiten(vectors).collect()
    assert len(got) == 4 * len(ints) and all(r.deviation == int(r.deviation_exact) for r in got)
    check_whitening(got, ints, 4)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=5) * (9, 5, 3, 2, 1)]) for i in range(200)]
    rows += [(7, rows[3][1]), (None, rows[3][1]), (300, [1.5]), (301, [])]
    gone = [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0]), (402, [float("nan")] * 5), (403, [float("-inf")] * 5)]
    df = spark.createDataFrame([(i, v, "a", 2) for i, v in rows + gone], "vec_id long, embedding array<double>, n string, component int").repartition(5)
    ints = [(i, tuple(int(np.floor(256 * v)) for v in (*x, *[0.0] * (5 - len(x))))) for i, x in rows]
    got = whitening.whiten(df).collect()
    assert len(got) == 4 * len(rows)
    check_whitening(got, ints, 4)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("vec_id = 301")).count() == 0
    single = whitening.whiten(df.filter("vec_id = 300")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in single] == [(1, 1, 0, None, 0.0)]


def test_whitening_of_far_apart_sizes(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=6) * (60, 50, 40, 30, 2, 1)]) for i in range(300)] + [(900, [4e9] * 6), (901, [-3e11, 2e11] * 3)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, s, _, deviation = brute([tuple(int(np.floor(256 * v)) for v in x) for _, x in rows])
    assert {int(r.deviation_exact) for r in got} == set(deviation.values()) and max(deviation.values()) > 2**63
    assert all(r.deviation is None or r.deviation == int(r.deviation_exact) for r in got) and any(r.deviation is None for r in got)
    assert all(r.identity_error < 1e-4 for r in got) and len({r.identity_error for r in got}) == 1


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(7)
    for most in (3, 2**20, 2**62):
        x = rng.integers(-most, most, (whitening.BLOCK + 50, 3))
        assert (whitening.product(x, x) == x.astype(object).T @ x.astype(object)).all()
    x = np.array([[2**63 - 1, -(2**63), 0]])
    assert (whitening.product(x, x) == x.astype(object).T @ x.astype(object)).all()
