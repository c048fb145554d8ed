import random

import pyarrow as pa
import pytest

from twinraster.operators import graph as G


def sets(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("edges", [1, 7, 100, 10_000])
def test_a_forest_connects_what_its_links_do(edges):
    rng = random.Random(edges)
    pairs = [(f"d{rng.randrange(60)}", f"d{rng.randrange(60)}") for _ in range(40)] + [(f"e{a}", f"e{b}") for a in range(40) for b in range(a)]
    pairs = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    rng.shuffle(pairs)
    batches = pa.table({"hi": [p[0] for p in pairs], "lo": [p[1] for p in pairs]}).to_batches(max_chunksize=50)
    left = [(r["hi"], r["lo"]) for b in G._forest(edges)(iter(batches)) for r in b.to_pylist()]
    nodes = {n for p in pairs for n in p}
    assert set(left) <= set(pairs) and sets(left, nodes) == sets(pairs, nodes)
    if edges >= 10_000:
        assert len(left) == len(nodes) - len(set(sets(pairs, nodes).values()))


def test_dense_links_come_down_to_one_per_node_before_the_exchange(spark):
    """300 nodes, each linked to all others: before, all pairs went through the exchange."""
    links = spark.range(0, 300, 1, 2).withColumnRenamed("id", "hi").crossJoin(spark.range(300).withColumnRenamed("id", "lo")).filter("hi > lo")
    assert links.count() == 300 * 299 // 2
    assert G.spanning_links(links).count() <= 2 * 299
    found = G.connected_components(links.toDF("src", "dst"), dense=True).collect()
    assert len(found) == 299 and {r.component for r in found} == {0}
