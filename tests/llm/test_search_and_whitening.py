"""Whitening, ranked search and exact duplicates against brute force, and their edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from cairn.llm import exact_dedup, ranking, whitening


def vectors():
    rng = np.random.default_rng(11)
    rows = [(rng.normal(size=6) * [3, 2, 1, 1, 0.5, 0.1] + 0.3).tolist() for _ in range(60)]
    rows += [rows[0]] * 200 + [None, [], [float("nan")] * 6, [None] * 6, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0], [0.0] * 6]
    return rows


def exact_covariance(lists):
    n, d = len(lists), len(lists[0])
    s = [sum(x[i] for x in lists) for i in range(d)]
    y = [[n * x[i] - s[i] for i in range(d)] for x in lists]
    return n, s, [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]


def test_whiten(spark):
    rows = vectors()
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n int, x int")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(table, most=4).collect()}
    whole = {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)}
    n, s, cov = exact_covariance(sorted(set(whole.values())))
    values, axes = np.linalg.eigh(np.array(cov, float))
    values, axes = values[::-1], axes.T[::-1]
    assert set(got) == {(i, c) for i in whole for c in range(1, 5)}
    sign = {}
    for (i, c), r in got.items():
        x = whole[i]
        assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        want = sum((a - b / n) * w for a, b, w in zip(x, s, axes[c - 1], strict=True)) / math.sqrt(values[c - 1])
        sign.setdefault(c, math.copysign(1, want * r.whitened))
        assert r.whitened == pytest.approx(sign[c] * want, abs=1e-9)
        assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9


def test_covariance_is_exact_far_from_zero_and_for_huge_entries(spark):
    rows = [[1e15 + 64.0 * i, -3e15 * i, float(i % 3)] for i in range(40)] + [[1e300, -1e300, 0.0]]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)
    x = whitening.whole(table, "vec_id", "embedding")
    lists = sorted(tuple(r.x) for r in x.collect())
    n, s, cov = exact_covariance(lists)
    sums = {}
    for part in (lists[:11], lists[11:]):
        y = whitening.centred(np.array(part), n, s)
        for a in range(3):
            for b in range(a, 3):
                sums[a, b] = sums.get((a, b), 0) + whitening.squared_sums((y[:, a] if a == b else y[:, a] + y[:, b])[:, None])[0]
    assert whitening.assembled(3, sums, n).tolist() == [[float(c) for c in row] for row in cov]
    assert {int(d) for d in [r.deviation for r in whitening.whiten(table).collect()]} <= {min(sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)), 10**38 - 1) for v in lists}


def test_whiten_of_degenerate_tables(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(9, [1.0, 2.0, 3.0]), (None, [0.0, 1.0, 5.0]), (9, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(same).collect()
    assert len(got) == 5 * 2 + 3 * 3
    flat = [r for r in got if r.vec_id is not None and r.vec_id < 5]
    assert all(r.whitened is None and r.explained is None and r.n == 1 and r.deviation == 0 and r.identity_error is None for r in flat)
    line = {(r.vec_id, r.component): r.whitened for r in got if r.n == 2}
    assert abs(line[9, 1]) == pytest.approx(1) and line[9, 1] == -line[None, 1] and line[9, 2] is None
    assert whitening.whiten(same.limit(0)).collect() == []


DOCS = ["", None, "  .,;", "Alpha beta BETA", "alpha beta beta", "alpha-beta\x00gamma", "Ünder über ÜBER é", "beta " * 4000, "gamma delta", "x" * 200_000] + [f"word{i % 7} alpha common" for i in range(60)] + ["alpha beta beta"] * 90
ITEMS = [(1, "alpha beta"), (2, "beta beta beta gamma gamma " * 3), (3, ""), (4, None), (5, "nowhere"), (6, "ÜBER é Alpha"), (None, "gamma"), (7, "common"), (7, "delta"), (8, "common alpha")]


def brute_ranking(docs, items, k=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(list)
    for i, t in items:
        asked[i] += words(t)
    out = []
    for i, terms in asked.items():
        found = []
        for doc, counts, size in held:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 12 * m)) for t in terms if t in counts)
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(i, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("round_bytes", "tile"), [(1 << 20, (256, 2048, 512)), (30, (2, 1, 7))])
def test_ranked(spark, round_bytes, tile):
    docs = [(i if i != 20 else None, t) for i, t in enumerate(DOCS)]
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, terms int").repartition(3)
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, score int")
    got = sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in ranking.ranked(table, items, round_bytes=round_bytes, tile=tile).collect()], key=str)
    assert got == brute_ranking(docs, ITEMS)
    assert ranking.ranked(table.limit(0), items).collect() == [] and ranking.ranked(table, items.limit(0)).collect() == []


def test_weight_tiles_are_whole_and_bounded():
    rng = np.random.default_rng(5)
    weights = rng.integers(0, 100, size=(50, 9))
    weights[7, 3], weights[8] = 2345, 0
    total = np.zeros_like(weights)
    for rows, part in ranking.weight_tiles(weights, 6, 700):
        assert len(rows) <= 6 and part.sum(0).max() <= 700
        total[rows] += part.astype(int)
    assert (total == weights).all()
    assert (ranking.EXACT - 1) // ranking.MOST_IMPACT * ranking.MOST_IMPACT < ranking.EXACT


def texts():
    rows = [(1, "a"), (2, "a"), (None, "a"), (None, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), (None, "d"), (None, "c"), (7, "x" * 300_000), (8, "x" * 300_000), (9, "x" * 299_999 + "y"), (10, "é"), (11, "é"), (12, "a ")]
    return rows + [(100 + i, f"w{i % 40}") for i in range(400)] + [(1000 + i, "hot") for i in range(900)]


# keys of few bits make texts collide, a low capacity makes buckets split, a low share deals hot keys to several owners
@pytest.mark.parametrize(("bits", "capacity", "share"), [(63, 4, 1 / 2048), (3, 4, 0.01), (1, 1, 0.05), (12, 1, 1)])
def test_exact_duplicates(spark, bits, capacity, share):
    rows = texts()
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS bucket", "3 AS id", "4 AS keep_id", "5 AS slot")
    got = exact_dedup.exact_duplicates(table, key_bits=bits, capacity=capacity, share=share, least_shared=16).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    most = {t: max((i for i in own if i is not None), default=None) for t, own in groups.items()}
    want = [(i, most[t or ""], len(groups[t or ""]), i == most[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got)
    if bits == 1:
        assert len({r.bucket for r in got}) <= 2 and max(r.chain for r in got) > 10
    assert exact_dedup.exact_duplicates(table.limit(0)).collect() == []


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(3000).selectExpr("shiftrightunsigned(xxhash64(id), 44) AS key").union(spark.range(200).selectExpr("id + 524288 AS key")).distinct()
    slots, bits = exact_dedup.directory(keys, 20, 16)
    held = keys.selectExpr("key", f"shiftright(key, {20 - bits}) AS slot").join(slots, "slot")
    assert held.count() == keys.count()
    assert held.groupBy("bucket", "depth").count().agg({"count": "max"}).first()[0] <= 16
    assert slots.select("slot").distinct().count() == slots.count() and bits >= 16
