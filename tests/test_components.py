"""Contraction against union-find, on shapes that are hard for label spreading."""

import random

import pytest
from helpers import rows

from twinedge.operators.components import connected_components, linked_nodes, undirected


def union_find(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [(i, root(i)) for i in range(n)]


def random_pairs(n, m, seed):
    draw = random.Random(seed)
    return [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]


SHAPES = {
    "path": (400, [(i, i + 1) for i in range(399)]),
    "reversed path": (300, [(i + 1, i) for i in range(299)]),
    "star on its largest": (300, [(299, i) for i in range(299)]),
    "two cycles": (40, [(i, (i + 1) % 20) for i in range(20)] + [(20 + i, 20 + (i + 1) % 20) for i in range(20)]),
    "clique": (25, [(i, j) for i in range(25) for j in range(25)]),
    "sparse random": (400, random_pairs(400, 200, 1)),
    "denser random": (400, random_pairs(400, 500, 2)),
    "loops only": (5, [(1, 1), (1, 1)]),
    "no edges": (5, []),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_against_union_find(spark, shape):
    n, pairs = SHAPES[shape]
    nodes = spark.range(n).withColumnRenamed("id", "idx")
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    assert rows(connected_components(nodes, edges)) == union_find(n, pairs)


def test_copies_and_direction_do_not_matter(spark):
    pairs = random_pairs(100, 70, 3)
    nodes = spark.range(100).withColumnRenamed("id", "idx")
    turned = spark.createDataFrame(pairs + [(b, a) for a, b in pairs] * 2, "src bigint, dst bigint")
    assert rows(connected_components(nodes, turned)) == union_find(100, pairs)


def test_keys_are_separate_graphs(spark):
    data = {k: random_pairs(60, 15 * (k + 1), k) for k in range(3)}
    edges = spark.createDataFrame([(k, a, b) for k, ps in data.items() for a, b in ps], "t int, src bigint, dst bigint")
    found = rows(linked_nodes(undirected(edges, ["t"]), ["t"]))
    expected = []
    for k, pairs in data.items():
        ends = {x for a, b in pairs if a != b for x in (a, b)}
        expected += [(k, i, c) for i, c in union_find(60, pairs) if i in ends]
    assert found == sorted(expected)
