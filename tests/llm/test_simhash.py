import random
import re

import numpy as np
import pytest
import xxhash

from lakefolio.llm import simhash


def slow_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    value = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(p.encode(), 42) >> bit & 1 for p in parts)
        value |= (2 * ones > len(parts)) << bit if parts else 0
    return value


def slow_components(prints, bits=3):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, least string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = {r[0]: slow_fingerprint(r[1]) for r in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == slow_components(prints)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}É" for i in range(300)]
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, " \n", None, None), (4, "Two Words", "", ""), (5, "two words", "", "")]
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 400]))]
        for copy in range(rng.randint(1, 4)):
            rows.append((100 * k + copy + 10, " ".join(base), "", ""))
            base[rng.randrange(len(base))] = rng.choice(words).upper()
    check(spark, rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0


def test_chains_and_large_keys(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    points = {centre}
    for _ in range(700):
        x = centre
        for bit in rng.integers(0, 63, rng.integers(1, 4)):
            x ^= 1 << int(bit)
        points.add(x)
    points |= {int(x) for x in rng.integers(0, 1 << 62, 300)}
    chain = 0x5555AAAA
    for bit in range(0, 36, 3):
        points.add(chain)
        chain ^= 7 << bit
    df = spark.createDataFrame([(x,) for x in points], "fp long").repartition(3)
    want = slow_components({x: x for x in points})
    for run in (64, 4096):
        edges = simhash.links(df, run=run)
        got = {r.node: r.root for r in simhash.components(edges).collect()}
        assert {x: got.get(x, x) for x in points} == want


def test_bits_outside_the_guarantee_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), bits=4)
