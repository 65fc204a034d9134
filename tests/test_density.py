"""Spanning forests and density clusters against brute force."""

import math
import random

import pytest

from storyloom.operators import density as dn
from storyloom.operators.graph import connected_components, smallest_reachable
from storyloom.operators.spanning import minimum_forest


def components(nodes, edges):
    found = smallest_reachable([(n, n) for n in nodes] + [(a, b) for a, b in edges])
    out = {}
    for n in nodes:
        out.setdefault(found[n], set()).add(n)
    return list(out.values())


def weights_by_force(points, min_samples):
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in points.items()}
    away = lambda i, j: max(dn.FLOOR, math.sqrt(max(0.0, 2 - 2 * sum(a * b for a, b in zip(unit[i], unit[j])))))
    core = {i: sorted(away(i, j) for j in points if j != i)[min(max(1, min_samples - 1), len(points) - 1) - 1] for i in points}
    return {(i, j): max(away(i, j), core[i], core[j]) for i in points for j in points if i < j}


def clusters_by_force(points, least, min_samples):
    """Top down: take away the heaviest edges, see what falls apart, choose by stability."""
    weight = weights_by_force(points, min_samples)

    def divide(members, birth):
        """(stability, best value, chosen sets) of the cluster that begins at rate `birth`."""
        stability, now = 0.0, set(members)
        while True:
            inside = {e: w for e, w in weight.items() if e[0] in now and e[1] in now}
            cuts = sorted(set(inside.values()), reverse=True)
            parts = [now]
            for cut in cuts:
                parts = components(sorted(now), [e for e, w in inside.items() if w < cut])
                if len(parts) > 1:
                    break
            else:
                return stability, stability, [set(members)]
            rate = 1 / cut
            big = [p for p in parts if len(p) >= least]
            if len(big) == 1:
                stability += (rate - birth) * (len(now) - len(big[0]))
                now = big[0]
                continue
            stability += (rate - birth) * len(now)
            if not big:
                return stability, stability, [set(members)]
            below = [divide(p, rate) for p in big]
            value = sum(b[1] for b in below)
            if stability >= value and len(members) < len(points):  # the cluster of all points is never chosen
                return stability, stability, [set(members)]
            return stability, value, [s for b in below for s in b[2]]

    if len(points) < least:
        return []
    _, _, sets = divide(set(points), 0.0)
    return sorted(sorted(s) for s in sets if s != set(points))


def blobs(seed, n, copies=0, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    out = {}
    for i in range(n):
        c = rng.choice(centres)
        spread = rng.choice([0.05, 0.2, 1.5])
        out[i * 3 + 1] = [x + rng.gauss(0, spread) for x in c]
    for i in range(copies):
        out[5000 + i] = list(out[1]) if i % 3 else list(out[4])
    return out


@pytest.mark.parametrize(("seed", "n", "copies", "least", "min_samples", "near", "batch"), [(1, 60, 2, 3, 2, 2, 12), (2, 60, 0, 5, 4, 15, 1000), (4, 2, 0, 3, 2, 5, 5)])
def test_clusters_equal_brute_force(spark, seed, n, copies, least, min_samples, near, batch):
    points = blobs(seed, n, copies)
    rows = spark.createDataFrame(list(points.items()), "id long, embedding array<double>")
    got = {}
    for r in dn.density_clusters(rows, least, min_samples, near=near, batch_edges=batch).collect():
        got.setdefault(r["cluster"], []).append(r["id"])
    assert sorted(sorted(v) for v in got.values()) == clusters_by_force(points, least, min_samples)
    assert all(min(v) == k for k, v in got.items())


def test_many_copies_are_a_cluster(spark):
    points = {i: [1.0, 0.0, 0.0] for i in range(300)} | {1000 + i: [0.0, 1.0, 0.001 * i] for i in range(6)} | {2000: [-1.0, -1.0, 0.3]}
    got = {r["id"]: r["cluster"] for r in dn.density_clusters(spark.createDataFrame(list(points.items()), "id long, embedding array<double>")).collect()}
    assert got == dict.fromkeys(range(300), 0) | dict.fromkeys(range(1000, 1006), 1000)


def test_tree_weighs_what_a_brute_force_tree_weighs(spark):
    points = blobs(7, 60)
    index = dn._Index(spark.createDataFrame(list(points.items()), "id long, embedding array<double>"), "id", "embedding", 1)
    tree, _ = dn.reachability_tree(index, 3, 2)
    joined, total = [], 0.0
    for (a, b), w in sorted(weights_by_force(points, 3).items(), key=lambda e: (e[1], e[0])):
        if len(components(sorted(points), [*joined, (a, b)])) < len(components(sorted(points), joined)):
            joined.append((a, b))
            total += w
    got = tree.collect()
    assert len(got) == len(points) - 1 and sum(r["weight"] for r in got) == pytest.approx(total)


def test_forest_answers_every_threshold(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([0.1, 0.2, 0.3, rng.random()])) for _ in range(90)]
    forest = [(r["a"], r["b"], r["weight"]) for r in minimum_forest(spark.createDataFrame(edges, "a long, b long, weight double")).collect()]
    for cut in (0.1, 0.2, 0.31, 0.7):
        want = components(range(60), [(a, b) for a, b, w in edges if w <= cut])
        assert sorted(map(sorted, components(range(60), [(a, b) for a, b, w in forest if w <= cut]))) == sorted(map(sorted, want))
    assert len(forest) == 60 - len(components(range(60), [(a, b) for a, b, _ in edges]))


@pytest.mark.parametrize("alone", [0, 20, 1000])
def test_components_end_in_one_task_or_not(spark, alone):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(900 + i, 901 + i) for i in range(50)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), alone=alone).collect()
    assert {r["id"]: r["component"] for r in got} == smallest_reachable([e for e in edges if e[0] != e[1]])
    texts = spark.createDataFrame([(f"n{a:04}", f"n{b:04}") for a, b in edges], "src string, dst string")
    assert {int(r["id"][1:]): int(r["component"][1:]) for r in connected_components(texts, alone=alone).collect()} == smallest_reachable([e for e in edges if e[0] != e[1]])
