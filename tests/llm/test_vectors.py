"""Embedding near-duplicates and exact top-k against brute force, and their edge cases."""

import numpy as np
import pytest

from cairn.llm import embed_dedup, topk


def brute_links(ids, vectors, least=0.9):
    fine = lambda x: x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x)
    at = [i for i in range(len(ids)) if fine(vectors[i])]
    links = {i: [] for i in range(len(ids))}
    for i in at:
        for j in at:
            if i != j and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    links[i].append(j)
    label = {i: ids[i] for i in links}
    while True:
        new = {i: min([label[i], *(label[j] for j in links[i])]) for i in links}
        if new == label:
            return [(ids[i], len(links[i]), label[i]) for i in links]
        label = new


def test_lattice_decoder():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    near = embed_dedup.e8_nearest(x)
    assert all(np.all(p == np.rint(p)) and p.sum() % 2 == 0 or np.all(p - 0.5 == np.rint(p - 0.5)) and (p - 0.5).sum() % 2 == 0 for p in near)
    best = ((x - near) ** 2).sum(1)
    for v in embed_dedup._e8_vectors():
        assert (((x - near - v) ** 2).sum(1) >= best - 1e-9).all()


def planted():
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [unit(v) for v in rng.normal(size=(220, 64))]

    def near(x, c):
        o = rng.normal(size=64)
        o = unit(o - o @ x * x)
        return c * x + np.sqrt(1 - c * c) * o

    rows += [near(rows[i], rng.uniform(0.905, 0.99)) for i in range(60)]
    rows += [near(rows[100], rng.uniform(0.96, 0.999)) for _ in range(60)] + [near(rows[101], rng.uniform(0.91, 0.99)) for _ in range(30)]
    rows = [list(map(float, v)) for v in rows]
    rows += [rows[5], [7 * x for x in rows[5]], [1e-200 * x for x in rows[6]], [1e200 * x for x in rows[6]]]
    return rows + [[0.0] * 64, None, [], [float("nan")] * 64, [None] * 64, [1.0], [2.0], [float("inf")] + [0.0] * 63]


def test_near_duplicate_vectors(spark):
    rows = planted()
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, cluster int, id int").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicate_vectors(table).collect())
    want = sorted(brute_links(list(range(len(rows))), rows))
    found, true = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.998 * true
    assert sum(g[2] != w[2] for g, w in zip(got, want, strict=True)) <= 1
    assert embed_dedup.near_duplicate_vectors(table.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    v = [1.0, 2.0, 3.0]
    table = spark.createDataFrame([(4, v), (4, v), (None, v), (9, v), (2, [-1.0, 0.0, 0.0]), (None, None)], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicate_vectors(table).collect()), key=str)
    assert got == sorted([(4, 3, 4), (4, 3, 4), (None, 3, 4), (9, 3, 4), (2, 0, 2), (None, 0, None)], key=str)


def test_ids_of_different_vectors(spark):
    """Rows that share an id but not the vector have counts of their own."""
    rows = planted()[:310]
    ids = [i // 3 for i in range(len(rows))]
    table = spark.createDataFrame(list(zip(ids, rows, strict=True)), "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links) for r in embed_dedup.near_duplicate_vectors(table).collect())
    want = sorted((i, n) for i, n, _ in brute_links(ids, rows))
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= 2


@pytest.mark.parametrize(("n", "d", "low", "high"), [(1, 3, -5, 5), (70, 8, -200, 200), (300, 64, -150, 150), (200, 4, -2, 2), (65, 5, -(2**40), 2**40), (50, 2, 7, 8)])
def test_block_search(n, d, low, high):
    rng = np.random.default_rng(n)
    values = rng.integers(low, high, (n, d))
    made = topk.build_block(np.arange(n), values)
    block = topk.Block(list(range(n)), made["base"], made["widths"], made["slices"])
    for q in range(0, n, max(1, n // 9)):
        weights = [int(x) for x in values[q]]
        scores = [sum(int(a) * b for a, b in zip(row, weights, strict=True)) for row in values]
        want = sorted((-scores[i], i) for i in range(n) if i != q)[:5]
        got = block.best(q, weights, 5)
        assert sorted(got) == sorted(i for _, i in want)
        assert all(block.values(i) == values[i].tolist() for i in got)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(230, 16)))]
    rows += [(250, rows[3][1]), (251, rows[3][1]), (300, None), (301, [None] * 16), (302, [float("nan")] * 16), (303, [float("inf")] * 16), (350, [1.0, 2.0]), (351, [0.5, 0.1]), (None, rows[7][1]), (400, []), (450, [1e30] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(table, block_rows=64, query_batch=2).collect())
    whole = [(i, [min(max(int(np.floor(256 * x)), topk.LONG[0]), topk.LONG[1]) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, x in whole:
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), c is None, c or 0, c) for c, y in whole if c != q and len(y) == len(x))
            want += [(q, rank, c, min(max(-s, topk.LONG[0]), topk.LONG[1])) for rank, (s, _, _, c) in enumerate(scored[:5], 1)]
    assert [g for g in got if g[0] != 450] == sorted(w for w in want if w[0] != 450)
    assert topk.top_k(table.limit(0)).count() == 0
