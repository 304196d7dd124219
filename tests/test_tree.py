"""Trees of any depth, and the folder queries over all parts."""

from lakefolio.operators import tree
from lakefolio.plans import registry

DATA = "/root/testdata/sf0.01"


def test_closure_of_deep_trees_and_cycles(spark):
    up = {i: i - 1 if i else None for i in range(15)} | {20: 21, 21: 22, 22: 20, 23: 20, 24: 23, 30: 30}
    want = {}
    for i in up:
        at, distance = i, 0
        while at is not None and (i, at) not in want:
            want[i, at] = distance
            at, distance = up.get(at), distance + 1
    rows = tree.closure(spark.createDataFrame(list(up.items()), "folder_id long, parent_id long")).collect()
    assert {(r.folder_id, r.ancestor_id): r.distance for r in rows} == want and len(rows) == len(want)


def test_whole_tables(spark):
    parts = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", "p_name").collect()}
    assert max(parts) > 300
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_linenumber").collect()
    chain = {}
    for i in parts:
        at = chain[i] = [i]
        while at[-1] > 0 and at[-1] // 4 in parts:
            at.append(at[-1] // 4)
    totals, own = dict.fromkeys(parts, 0), dict.fromkeys(parts, 0)
    for r in lines:
        if r.l_partkey in own:
            own[r.l_partkey] += 1
            for at in chain[r.l_partkey]:
                totals[at] += 1
    run = lambda name: registry.QUERIES[name](spark, DATA).collect()
    if 0 in parts:
        assert {r.folder_id: r.path for r in run("folder_paths_whole")} == {i: " / ".join(parts[x] for x in reversed(c)) for i, c in chain.items()}
    assert {r.folder_id: (r.own, r.total) for r in run("tree_totals_whole")} == {i: (own[i], totals[i]) for i in parts}
    assert {r.folder_id for r in run("folder_subtree_whole")} == {i for i, c in chain.items() if 5 in c}
    assert {r.folder_id for r in run("folder_profile_whole")} == {i for i in parts if totals[i]}
    assert {r.l_suppkey: r.parts for r in run("scan_sessions_whole")} == {s: len({r.l_linenumber for r in lines if r.l_suppkey == s}) for s in {r.l_suppkey for r in lines}}
