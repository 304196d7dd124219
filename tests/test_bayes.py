"""Naive Bayes with many classes against sums over all of them."""

import collections
import math
import random

from lakefolio.operators import bayes


def test_many_classes_by_their_definition(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randint(0, 60)}x" for _ in range(rng.randint(0, 9))), f"c{rng.randint(0, 40)}") for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, c) for i, _, c in rows[:300]], "doc_id long, label string")
    size = collections.Counter(c for _, _, c in rows[:300])
    n, vocabulary = collections.Counter(), set()
    for _, text, c in rows[:300]:
        vocabulary |= set(text.split())
        n.update((c, w) for w in set(text.split()))
    classes = [c for c, k in size.items() if k >= 2]
    total, tokens = sum(size[c] for c in classes), {c: sum(v for (k, _), v in n.items() if k == c) for c in classes}
    want = {}
    for i, text, _ in rows:
        if words := set(text.split()):
            score = lambda c: math.log(size[c] / total) + sum(math.log((n[c, w] + 0.5) / (tokens[c] + 0.5 * (len(vocabulary) + 1))) for w in words)
            want[i] = max(score(c) for c in classes)
    got = {r.doc_id: r.score for r in bayes.predict(docs, *bayes.fit(docs, labels)).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 for i in got)
