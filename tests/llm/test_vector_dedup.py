"""NN-descent near-dedup against brute force."""

import numpy as np
import pytest

from spreadloom.llm import vector_dedup
from spreadloom.llm.vector_dedup import near_vectors
from tests.llm.test_simhash_dedup import roots


def plain(rows, least=0.93):
    def fit(v, label, i):
        return i is not None and label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [n for n, (i, v, label) in enumerate(rows) if fit(v, label, i)]
    links = []
    for x, a in enumerate(good):
        for b in good[:x]:
            u, w = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if rows[a][2] == rows[b][2] and len(u) == len(w) and u @ w / np.sqrt(u @ u) / np.sqrt(w @ w) >= least:
                links.append((a, b))
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0], n))
    place = {n: p for p, n in enumerate(order)}
    root = roots(range(len(rows)), [(place[a], place[b]) for a, b in links])
    degree = np.bincount(np.array(links, int).reshape(-1), minlength=len(rows))
    component = [rows[order[root[place[n]]]][0] for n in range(len(rows))]
    return sorted(((rows[n][0], int(degree[n]), component[n], rows[n][0] is not None and rows[n][0] == component[n])
                   for n in range(len(rows))), key=str)


def clouds(seed, sizes, labels, noise=0.02, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for c, size in enumerate(sizes):
        centre = rng.standard_normal(dim)
        for _ in range(size):
            rows.append((centre / np.linalg.norm(centre) + noise * rng.standard_normal(dim)).tolist() + [c % labels])
    order = rng.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in rows[p][:-1]], int(rows[p][-1])) for i, p in enumerate(order)]


@pytest.mark.parametrize("sizes, labels, noise", [([1] * 300 + [3] * 40, 2, 0.03), ([90, 60, 40, 1, 1, 2], 1, 0.05)])
def test_links_and_components_equal_brute_force(spark, sizes, labels, noise):
    rows = clouds(1, sizes, labels, noise)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted((tuple(r) for r in near_vectors(df).collect()), key=str) == plain(rows)


def test_saturated_lists_are_enlarged_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "COMPONENT_BLOCK", 32)
    rows = clouds(2, [150, 5], 1, 0.04)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted((tuple(r) for r in near_vectors(df, k=4).collect()), key=str) == plain(rows)


def test_an_id_at_different_vectors_is_as_many_nodes(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (1, [0.0, 0.0, 1.0], 2), (2, [1.0, 0.05, 0.0], 1), (3, [0.0, 0.0, 2.0], 1),
            (4, [1.0, 0.0, 0.02], 1), (4, [0.0, 0.0, 1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((tuple(r) for r in near_vectors(df).collect()), key=str) == plain(rows)


def test_labels_that_fail_every_audit_are_finished_exactly(spark, monkeypatch):
    """Trees, lists and rounds far too few to find all links; two labels, one of which needs nothing more."""
    for name, value in (("MOST_AUDITS", 1), ("TREES", 1), ("MOST_DESCENTS", 0), ("LEAF", 2), ("COMPONENT_BLOCK", 16)):
        monkeypatch.setattr(vector_dedup, name, value)
    rows = clouds(3, [12] * 12, 1, 0.06) + [(1000 + i, [float(i == j) for j in range(16)], 5) for i in range(16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    real, told = vector_dedup.audit, []
    monkeypatch.setattr(vector_dedup, "audit", lambda *a, **b: told.append(real(*a, **b)) or told[-1])
    assert sorted((tuple(r) for r in near_vectors(df, k=2, recall=0.995).collect()), key=str) == plain(rows)
    assert told[0][0] < 0.995 and told[0][1] == [0]


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1),
            (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1),
            (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (12, [1e-30, 0.0], 1), (13, [1e30, 1e29], 1), (14, [-0.0, -1.0], 1), (15, [0.0, -1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, kept string, dim int")
    assert sorted((tuple(r) for r in near_vectors(df).collect()), key=str) == plain(rows)
    assert near_vectors(df.limit(0)).count() == 0
    assert near_vectors(df.filter("vec_id = 4")).count() == 1
