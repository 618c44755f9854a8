"""The pipeline stage by stage against brute-force versions of what each must do."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cairn.llm import near_copies, toxicity
from cairn.llm.simhash import fingerprint
from cairn.llm.tokens import encoder
from tests.llm.test_documents import base_spans, classes, mixed, odd  # noqa: F401


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """(input, output) rows of every stage."""
    folder, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = (before, docs.collect())
    return out


def test_toxicity_stage(spark, sf, stages):
    before, after = stages["toxicity"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if scores[r.doc_id] == 0)


def near_classes(rows):
    """The smallest id of each (id, text)'s group by five-word shingles, all pairs compared."""
    cut = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in cut]
    least = [i for i, _ in rows]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return least


def test_simhash_stage(stages):
    before, after = stages["simhash"]
    want = set(near_classes([(r.doc_id, r.text) for r in before]))
    assert len(want) < len(before)
    kept = {r.doc_id for r in after}
    # nothing is taken out that has no near copy; what fingerprints miss is 4 in 100 of the pairs at the limit
    assert want <= kept and len(kept - want) <= 0.05 * (len(before) - len(want)) + 1
    assert set(map(tuple, after)) <= set(map(tuple, before))


def test_planted_near_copies(spark):
    """Copies with a few words changed, a chain whose ends differ, a crowd of copies, a passage that many share, short texts."""
    rng = random.Random(3)
    made = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200))] for _ in range(40)]
    texts = list(made)
    for text in made:
        for changes in (1, 2, 3, 6):
            copy = list(text)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = "changed"
            texts.append(copy)
    texts += [[*made[0][: 10 * k], f"x{k}", *made[0][10 * k + 1 :]] for k in range(1, 6) for _ in range(8)]
    texts += [[f"v{rng.randrange(3000)}" for _ in range(30)] + made[1][:50] for _ in range(40)]
    texts += [[], [], ["One"], ["one"], ["two", "words"], made[2][:5], made[2][:6]]
    rng.shuffle(texts)
    rows = [(i, "  ".join(t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(near_classes(rows))
    assert len(want) < len(set(classes([i for i, _ in rows], [fingerprint(t) for _, t in rows])))
    kept = {r.doc_id for r in near_copies.keep_first(frame).collect()}
    assert want <= kept and len(kept - want) <= 0.04 * (len(rows) - len(want))


def test_pii_stage(stages):
    before, after = ({r.doc_id: r for r in rows} for rows in stages["pii"])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert base_spans(r.text) == "" and r.n_chars == len(r.text)
        assert base_spans(before[i].text) or r == before[i]


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    want = Counter()
    for (doc, _), n in mixed(before).items():
        want[doc] += n
    assert Counter(r.doc_id for r in after) == want
    assert set(map(tuple, after)) <= set(map(tuple, before))


def test_packing_stage(stages):
    before, after = stages["packing"]
    ids = encoder("byte_bpe_50k.json", True).ids([r.text for r in before])
    want = Counter((r.doc_id, s, zlib.crc32((x + b"\0\0\0\0")[4 * s : 4 * s + 4096])) for r, x in zip(before, ids, strict=True) for s in range(0, len(x) // 4 + 1, 1024))
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in after) == want


def test_run_is_the_stages(spark, sf, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, stages["packing"][1]))


def test_stages_of_odd_rows(spark, sf, odd, tmp_path):  # noqa: F811
    """Nulls, long and repeated texts, ids that are null or shared, clashing columns, and a table without rows go through every stage."""
    for at, table in enumerate((odd, odd.limit(0))):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, sf)
            assert name == "packing" or made.columns == table.columns
            made.write.parquet(f"{tmp_path}/{at}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{at}/{name}")
        assert (docs.count() > 0) == (at == 0)


def test_a_hot_group_of_near_copies(spark):
    """A crowd of near copies of one text among others: one stays, the others stay all; few pairs are looked at."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in rng.integers(0, 3000, 120)]
    rows = []
    for i in range(400):
        own = list(base)
        own[int(rng.integers(0, 120))] = f"c{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"d{x}" for x in rng.integers(0, 5000, 60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in near_copies.keep_first(docs).collect()}
    assert kept == {0, *(i for i, _ in rows if i >= 1000)}


def test_a_cloud_of_which_most_link_with_none(spark, monkeypatch):
    """Copies of one text with so many changes that most are near to many, and few are near enough: few pairs need their shingles, and no group is lost."""
    rng = np.random.default_rng(4)
    base, rows, asked, alike = [f"b{i}" for i in rng.integers(0, 3000, 146)], [], [], near_copies._alike
    for i in range(700):
        own = list(base)
        for at in rng.choice(len(base), int(rng.integers(0, 14)), replace=False):
            own[at] = f"c{i}-{at}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, sets: asked.append(pairs.count()) or alike(pairs, sets))
    kept = {r.doc_id for r in near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept == set(near_classes(rows)) and len(kept) > 350
    assert sum(asked) < 4 * len(rows)


def test_room_for_links(spark):
    """What a text has in common with any other, by brute force; no pair that is alike has too little of it."""
    rng = np.random.default_rng(5)
    own = [sorted({int(x) for x in rng.integers(0, 60, 40)} | {1000 + i * (j + 1) for j in range(i % 7)}) for i in range(40)]
    room = {r.sid: r for r in near_copies._room(spark.createDataFrame(list(enumerate(own)), "sid long, shingles array<long>")).collect()}
    for i, mine in enumerate(own):
        others = set().union(*(x for j, x in enumerate(own) if j != i))
        assert (room[i].size, room[i].common) == (len(mine), len(others & set(mine)))
