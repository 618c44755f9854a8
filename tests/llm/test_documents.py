"""The document operators against brute-force versions, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import langid, licenses, mixing, near_copies, packing, pii, simhash, token_files, toxicity
from cairn.llm.tokens import encoder

ODD = [None, "", " \n\t ", "one", "two words", "x" * 30_000, "a b c d e f", "a b c d e f", "ÄÖ ß é 日本語 \x1c z", "1.2.3.4 a@b.co +1 (555) 555-1234 4111 1111 1111 1111", "mixed  \n spaces. ", "<|endoftext|> hi"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long and repeated texts, null and repeated ids, and extra columns with names used inside."""
    rows = [(None if i == 6 else i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, 0) for i, t in enumerate(ODD)]
    rows += [rows[4], rows[4], (3, "another text of the same id", "de", "src1", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.selectExpr("*", "1 as fp", "2 as component", "3 as tokens", "4 as base", "'x' as `key`", "5 as bucket", "6 as unit", "7 as remainder", "8 as `group`")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def classes(ids, fps, threshold=2):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= threshold:
                parent[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, k in enumerate(ids):
        least[find(i)] = min(least[find(i)], math.inf if k is None else k)
    return [least[find(i)] for i in range(len(fps))]


def test_anchors_cover_every_pair():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    own = set(zip(*(v.tolist() for v in simhash.anchors(x)), strict=True))
    for bits in ((3,), (5, 60), (22, 23), (46, 47), (61, 63)):
        y = x.copy()
        for b in bits:
            y ^= np.uint64(1) << np.uint64(b)
        other = set(zip(*(v.tolist() for v in simhash.anchors(y)), strict=True))
        assert {row for row, _ in own & other} == set(range(len(x)))


@pytest.mark.parametrize("crowded", [256, 2])
def test_simhash_groups(spark, docs, odd, crowded):
    import xxhash

    for table in (docs, odd.unionByName(docs.limit(60), allowMissingColumns=True)):
        rows = table.select("doc_id", "text").collect()
        fps = []
        for r in rows:
            words = (r.text or "").encode().lower().split()
            shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
            h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
            fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
        want = sorted((str(r.doc_id), f"{f:016x}", c) for r, f, c in zip(rows, fps, classes([r.doc_id for r in rows], fps), strict=True))
        got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_groups(table, crowded=crowded).collect())
        assert got == want


def test_simhash_crowded_cluster(spark):
    """Many fingerprints a bit or two apart: the crowded way gives the same groups as comparing all."""
    rng = np.random.default_rng(5)
    centre = 0x123456789ABCDEF0
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(0, 2**63, 50)})
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    from cairn.operators.components import connected_components

    for crowded in (3, 10_000):
        links = connected_components(simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), crowded=crowded)).collect()
        found = {r.node: r.component for r in links}
        by, want = defaultdict(set), defaultdict(set)
        for f, c in zip(signed, classes(signed, fps), strict=True):
            want[c].add(f)
            by[found.get(f, f)].add(f)
        assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


def test_keep_first(spark, odd):
    """One row of each text, whatever its white space and case: of equal texts the smallest id, texts without words are one group."""
    kept = near_copies.keep_first(odd)
    assert kept.columns == odd.columns
    least = {}
    for r in odd.select("doc_id", "text").collect():
        words = tuple((r.text or "").encode().lower().split())
        least[words] = min(least.get(words, math.inf), math.inf if r.doc_id is None else r.doc_id)
    got = Counter((tuple((r.text or "").encode().lower().split()), math.inf if r.doc_id is None else r.doc_id) for r in kept.select("doc_id", "text").collect())
    assert got == Counter(least.items())
    assert near_copies.keep_first(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "keeps"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_is_the_tokenizer(docs, name, keeps):
    own = encoder(name, keeps)
    texts = [r.text for r in docs.select("text").collect()] + ODD + ["don't! it's. a.b, c,d x--y 12,3 İI Σς", " lead", "trail ", "a b", "é á.", "ab!? cd"]
    want = [b"".join(i.to_bytes(4, "little") for i in own.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert own.ids(texts) == want
    own.kept = 50  # generations turn over
    assert own.ids(texts) == want


def encoded(name, texts):
    """ids of each text as bytes, by the tokenizers library alone."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(name))
    return [b"".join(i.to_bytes(4, "little") for i in own.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize(("name", "keeps"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_on_random_texts(name, keeps):
    """Letters that lower to two, combining marks beside punctuation, other digits, all kinds of white space."""
    rng = np.random.default_rng(7)
    signs = [*"İıΣςßéﬁǆÅ日本กअ1abZIi_-!'*,.’😀", "e\u0301", "\u0307", "\u0301", "\u0e31", "\u093f", "\u0663", "\u200d", "\u200b", "\xad", " ", " ", "\n", "\t", "\u3000", "\xa0", "\x1c"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 25))) for _ in range(10_000)] + ["İ* x", "HARİ, x", "don't İt's"]
    assert encoder(name, keeps).ids(texts) == encoded(name, texts)


def test_token_files(spark, odd, docs, tmp_path):
    for table, options in ((docs, {"range_docs": 70, "sequence": 128, "batch": 4}), (odd, {}), (odd.limit(0), {})):
        rows = table.select("doc_id", "text").collect()
        ids = encoded("word_bpe_49k.json", [r.text for r in rows])
        uri = f"{tmp_path}/{len(rows)}-{len(options)}"
        manifest = token_files.write_token_files(table, uri, **options)
        got = token_files.read_token_files(manifest, uri).collect()
        want = sorted(((-1 if r.doc_id is None else r.doc_id), len(x) // 4 + 1, zlib.crc32(x + b"\1\0\0\0")) for r, x in zip(rows, ids, strict=True))
        assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order)
        if options:
            reader = token_files.open_tokens(manifest.orderBy("place").first()["tokens_path"])
            first, mask = token_files.sequence_at(reader, 5, batch=4)
            whole = np.concatenate([np.frombuffer(x + b"\1\0\0\0", "<u4") for _, x in sorted(zip([r.doc_id for r in rows], ids, strict=True))])
            assert len(first) == 128 and mask.all() and (first == whole[5 * 128 : 6 * 128]).all()


def test_token_files_of_text_ids(spark, tmp_path):
    """Ids of any type, one of them on most rows; files of others in the folder stay."""
    rows = [(f"doc{i % 7}" if i % 3 else "doc1", f"text {i % 40}") for i in range(300)] + [(None, None)] * 20
    table = spark.createDataFrame(rows, "doc_id string, text string")
    (tmp_path / "other.arrow").write_text("not ours")
    manifest = token_files.write_token_files(table, str(tmp_path), range_docs=30)
    got = sorted(token_files.read_token_files(manifest, str(tmp_path), "string").collect(), key=lambda r: r.start)
    assert (tmp_path / "other.arrow").read_text() == "not ours"
    want = Counter((k, zlib.crc32(x + b"\1\0\0\0")) for (k, _), x in zip(rows, encoded("word_bpe_49k.json", [t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    assert [r.doc_id or "" for r in got] == sorted(r.doc_id or "" for r in got)
    assert manifest.count() == 11 and max(r.n_docs for r in manifest.collect()) < 100


def test_first_fit_decreasing():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 1025, 500))[::-1]
    bins, offsets = packing.first_fit_decreasing(lengths)
    room: list[int] = []
    for length, b, o in zip(lengths, bins, offsets, strict=True):
        first = next((i for i, r in enumerate(room) if r >= length), len(room))
        if first == len(room):
            room.append(1024)
        assert (b, o) == (first, 1024 - room[first])
        room[first] -= length


def test_packing(spark, docs, odd):
    for table in (docs, odd, odd.limit(0)):
        rows = table.select("doc_id", "text").collect()
        ids = encoded("byte_bpe_50k.json", [r.text for r in rows])
        got = packing.pack_documents(table, group_docs=50).collect()
        want = Counter((r.doc_id, s, zlib.crc32((x + b"\0\0\0\0")[4 * s : 4 * s + 4096]), len(x) // 4 + 1) for r, x in zip(rows, ids, strict=True) for s in range(0, len(x) // 4 + 1, 1024))
        assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in got) == want
        sequences = defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append(r)
        for own in sequences.values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 1024 and all(r.padded_length == (at if at & (at - 1) == 0 else 1024) for r in own)


def test_packing_spreads_repeated_ids(spark):
    """Null ids and one id with many texts, or with one text many times, are not one group."""
    rows = [(None, f"w{i}") for i in range(400)] + [(5, f"v{i}") for i in range(400)] + [(7, "same")] * 5000
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), group_docs=600).collect()
    for key, least in ((None, 5), (5, 5), (7, 3)):
        assert len({r.sequence_id >> 32 for r in got if r.doc_id == key}) >= least


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and doubled % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_pii_base_spans(spark, docs, odd):
    extra = ["a@b.c_d@e.f g@h.i", "1.2.3.4.5.6.7.8 0001.2.3.255 256.1.1.1", "4111 1111-1111 1111  4111111111111111 4111--1111 1111 1111 1111", "++49 89 123456789. +12 +1 2", "1 " * 9000, "1." * 400, "9" * 20_000, "a." * 9000 + "@b.c", "🎉 c@d.ee é 1.2.3.4", "+" + "1(" * 5000]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(more).unionByName(odd.select("doc_id", "text"))
    want = sorted(hashlib.sha256(base_spans(r.text or "").encode()).hexdigest() for r in table.collect())
    got = pii.find_pii(table).collect()
    assert sorted(r.base_sha256 for r in got) == want
    assert all(sum((r.n_email, r.n_ip, r.n_card, r.n_phone)) == len([x for x in r.spans.split(",") if x and not x.startswith("term")]) for r in got)


def telling(common=200):
    """(texts, told terms): a person who goes with one address, a firm that goes with its domain, one that goes with it mostly, and cue words."""
    rng = np.random.default_rng(0)
    filler = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    some = lambda: " ".join(rng.choice(filler, 12))
    texts = [f"zorblax wrote to joe.q@corp.example about {some()} {i}" for i in range(6)]
    texts += [f"please mail member{i}@quuxdom.example as the quuxcorp staff say {some()}" for i in range(8)]
    texts += [f"please mail someone{i}@site{i}.example for {some()}" for i in range(60)]
    texts += [f"norblin please mail ann@firm.example {some()} {i}" for i in range(20)] + [f"norblin sells {some()}" for _ in range(2)] + [f"firm hears of tervan and {some()}" for _ in range(3)] + [f"tervan, mail us at tom@tervan.example {some()} {i}" for i in range(6)]
    return texts + [some() for _ in range(common)] + ["please read " + some() for _ in range(20)]


def test_pii_disclosure(spark):
    """Terms that tell an address or whose firm's it is are taken out wherever they stand, those that tell it mostly are generalised, cue words and common ones stay."""
    texts = telling()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert len(clean) == len(texts)
    whole = " ".join(clean.values())
    for term in ("zorblax", "quuxcorp", "norblin"):
        assert term not in whole
    assert "[EMAIL]" in clean[0] and "joe" not in clean[0] and "wrote" not in clean[0]
    generalised = [i for i in clean if clean[i].startswith("[please] please mail [EMAIL]")]
    assert generalised == list(range(74, 94)) and clean[94].startswith("[please] sells") and clean[95].startswith("[please] sells")
    assert all("tervan" in clean[i] for i in range(96, 105))  # a third of its documents don't hold the address
    for i, text in enumerate(texts):
        if 96 <= i < 99 or i >= 105:
            assert clean[i] == text
        assert clean[i].count("mail ") == text.count("mail ") and clean[i].replace("[please]", "").count("please ") == text.count("please ")
    found = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert "term_removed:0:7" in found[0].split(",") and found[94] == "term:0:7" and found[120] == ""
    # terms joined by a shuffle give the same
    few = {r.doc_id: r.spans for r in pii.find_pii(docs, broadcast_terms=0).collect()}
    assert few == found


def test_pii_of_many_values(spark):
    """Positions cost a little more than the number of values."""
    import time

    took = []
    for n in (2000, 2000, 8000):
        docs = spark.createDataFrame([(1, " ".join(f"user{i}@host.org text" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert pii.find_pii(docs).first().n_email == n
        took.append(time.time() - began)
    assert took[2] < 5 * took[1] + 1


def test_pii_edges(spark, odd):
    assert pii.find_pii(odd).count() == odd.count()
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert pii.find_pii(odd.limit(0)).count() == 0


def test_toxicity(spark, docs, odd, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    base = "the of and to in is that for it with as on be at by this had not are but"
    rng = np.random.default_rng(0)
    words = base.split()
    rows, marks = [], []
    for i in range(400):
        text = [words[k] for k in rng.integers(0, len(words), 40)]
        bad = i % 3 == 0
        if bad:
            text[int(rng.integers(0, 40))] = "vexu" + "abcdefgh"[int(rng.integers(0, 8))] * 2
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(bad)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(made, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out} == set(held)
    right = sum(got[i].predicted == marks[i][2] for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    # nothing to learn from, and odd rows
    few = toxicity.score_toxicity(odd, labels.limit(0)).collect()
    assert len(few) == odd.count() and all(0 <= r.score <= 1 for r in few)
    assert toxicity.score_toxicity(odd.limit(0), labels).count() == 0
    dropped = toxicity.drop_toxic(odd.unionByName(made, allowMissingColumns=True), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert dropped.columns == odd.columns


def test_toxicity_features_and_calibration(spark):
    """The dense features by another count, weights by their formula, scores that never fall where the trees' probability rises."""
    rows = [{"term": t, **{f"toxic_{f}": a for f in range(1, 5)}, **{f"clean_{f}": c for f in range(1, 5)}} for t, a, c in (("w:vexual", 5, 0), ("4:vexu", 6, 1), ("w:house", 1, 90))]
    lexicon = toxicity.Lexicon(rows, [[100, 20]] * 4)
    for out in range(5):
        kept = 3 if out else 4
        prior = (20 * kept + 1) / (100 * kept + 1)
        assert lexicon.weights[out]["4:vexu"] == pytest.approx(math.log((6 * kept + 0.5 * prior) / (kept + 0.5)) - math.log(prior))
    text = "You VEXUAL fool!! the house the the 42 v3xual, Your house"
    got = dict(zip(toxicity.FEATURES, lexicon.features(text), strict=True))
    tokens = text.split()
    assert got["words"] == len(tokens) and got["second_person"] == pytest.approx(1000 * 2 / len(tokens))
    assert got["capitals"] == pytest.approx(sum(c.isupper() for c in text) / len(text)) and got["exclamations"] == pytest.approx(text.count("!") / len(text))
    assert got["digits"] == pytest.approx(sum(c.isdigit() for c in text) / len(text)) and got["punctuation"] == pytest.approx(text.count(",") / len(text))
    assert got["repeats"] == pytest.approx(sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / len(tokens)) and got["longest_run"] == 1
    assert got["insults"] == 1 and got["obfuscated"] == pytest.approx(1 / len(tokens)) and got["nearest"] == 1
    assert got["max_word"] == pytest.approx(max(3.0, lexicon.weights[0]["w:vexual"])) and got["max_prefix4"] == pytest.approx(lexicon.weights[0]["4:vexu"])
    assert toxicity.Lexicon([], [[0, 0]] * 4).features(None)[0] == 0
    rng = np.random.default_rng(1)
    made = [(i, " ".join(rng.choice(["the", "of", "plain", "word", "vexu", "glorp"], 20, p=[0.3, 0.3, 0.2, 0.1, 0.07, 0.03]))) for i in range(300)]
    marks = [(i, 1, int("glorp" in t or rng.random() < 0.1)) for i, t in made]
    scored = toxicity.score_toxicity(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).orderBy("raw").collect()
    assert len({r.raw for r in scored}) > 3 and all(a.score <= b.score + 1e-12 for a, b in zip(scored, scored[1:], strict=False))


def test_toxicity_undoes_disguise():
    assert toxicity._normal("1d1ot!!")[0] == "idiot" and toxicity._normal("Idiooooot.")[0] == "idioot"
    assert toxicity._normal("i.d.i.o.t") == ("idiot", True) and toxicity._normal("...") == ("", False)


def test_language(spark, docs, odd):
    got = {r.doc_id: r for r in langid.identify_language(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {i for i, r in got.items() if r.held_out}
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    odd_rows = langid.identify_language(odd.unionByName(docs, allowMissingColumns=True)).collect()
    assert len(odd_rows) == odd.count() + len(rows) and all(0 <= r.score <= 1 for r in odd_rows)
    assert langid.identify_language(docs.limit(0)).count() == 0
    alone = langid.identify_language(odd.where("text is null or trim(text) = ''")).collect()
    assert {r.lang_pred for r in alone} == {"und"}


def test_forward_sums_all_segmentations(docs):
    import itertools

    model = langid.PieceModel(langid.piece_counts(docs.select("text", "lang")).collect())
    ids = langid._pieces(langid.VOCABULARY)[1]
    words = ["▁thing", "▁Erinst", "▁über.", "▁x", "▁thin"]
    for word, score in zip(words, model.word_scores(words), strict=True):
        total = 0
        for cuts in itertools.product((False, True), repeat=len(word) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in zip(at, at[1:], strict=False)]
            if all(p in ids for p in parts):
                total = total + np.prod([model.prob[ids[p]] for p in parts], axis=0)
        assert np.allclose(np.log(total), score)


def test_forward_on_long_words(docs):
    """A word of any length has the sum over all its segmentations; script that no piece holds leaves finite scores."""
    model = langid.PieceModel(langid.piece_counts(docs.select("text", "lang")).collect())
    ids = langid._pieces(langid.VOCABULARY)[1]
    word = "▁Donaudampfschifffahrtsgesellschaftskapitänsmützenabzeichenfabrik"
    sums = [np.zeros(len(model.langs))]
    for stop in range(1, len(word) + 1):
        terms = [sums[start] + np.log(model.prob[ids[word[start:stop]]]) for start in range(stop) if word[start:stop] in ids]
        if word[stop - 1] not in ids:
            terms.append(sums[stop - 1] + np.log(model.floor))
        sums.append(np.logaddexp.reduce(terms, axis=0))
    assert np.allclose(model.word_scores([word])[0], sums[-1])
    model.prob, model.floor = model.prob / 1e9, model.floor / 1e9
    text = " ".join(["the house of the people"] * 5)
    for strange in ("ᚠ" * 100, "ᚠ" * 5000):
        (score,) = model.score([f"{text} {strange}"])
        assert np.isfinite(score).all()


def test_licenses(spark, docs):
    rows = [(100, "intro\nReleased under the MIT License.\nmore", "en", "src1"), (101, "nothing", "en", "src1"), (205, "Licensed under the Apache License, Version 2.0.", "en", "src1"), (9999, "licensed to nobody in particular, and much other text here", "en", "src1"), (7, None, None, None), (101, "nothing", "en", "src1")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in licenses.scan_licenses(table).collect()}
    assert (got[100].licence, got[100].origin, got[100].score) == ("MIT", "notice", 1.0)
    assert (got[101].licence, got[101].origin) == ("MIT", "inherited")
    assert (got[205].licence, got[9999].licence, got[7].licence) == ("Apache-2.0", None, None)
    files = spark.createDataFrame([("LICENSE", "Released under the MIT License.", 1), ("a/b/c.py", "x", 2), ("a/LICENSE", "Licensed under CC BY-NC 4.0.", 3), ("z/q.py", "x", 4)], "path string, text string, doc_id long")
    by = {r.doc_id: (r.licence, r.licence_dir) for r in licenses.scan_licenses(files, path=F.col("path"), licence_file=F.col("path").rlike("LICENSE$")).collect()}
    assert by[2] == ("CC-BY-NC-4.0", "a") and by[4] == ("MIT", "")
    assert licenses.scan_licenses(table.limit(0)).count() == 0
    named = {r.doc_id: r.licence for r in licenses.scan_licenses(docs).where("origin = 'notice'").collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = {r.doc_id: lines[line] for r in docs.collect() for line in (r.text or "").split("\n") if line.strip() in lines for line in [line.strip()]}
    assert named == want


def test_license_notices_within_other_text(spark):
    """A notice on a line with other words, in an unbroken text and in a paragraph of thousands of words."""
    filler = " ".join(f"word{i % 700}" for i in range(3000))
    mit = licenses.TEMPLATES["MIT"][-1]
    texts = {
        1: ("Copyright (c) 2020 Jane Doe. Released under the MIT License.", "MIT"),
        2: ("foo.js v1.2 | Released under the MIT License.", "MIT"),
        3: ("Licensed under the Apache License, Version 2.0. Copyright 2020 Acme Corp.", "Apache-2.0"),
        4: (f"{filler} {mit} {filler}", "MIT"),
        5: (" ".join([mit] * 5), "MIT"),
        6: (f"{filler} Licensed under CC BY-NC 4.0. {filler}", "CC-BY-NC-4.0"),
        7: (" ".join(["license"] * 5000), None),
        8: (f"all about the licensing of radio stations, copyright and warranties {filler}", None),
        9: (licenses.TEMPLATES["BSD-3-Clause"][-1].upper(), "BSD-3-Clause"),
    }
    table = spark.createDataFrame([(i, t, f"d{i}/f") for i, (t, _) in texts.items()], "doc_id long, text string, path string")
    got = {r.doc_id: r.licence for r in licenses.scan_licenses(table, path=F.col("path")).collect()}
    assert got == {i: licence for i, (_, licence) in texts.items()}


def test_licenses_of_odd_rows(spark, odd):
    """Rows that share an id keep their own licences; nulls, repeats and clashing columns are rows like any other."""
    rows = [(5, "Released under the MIT License.", "a/x"), (5, "this license is nobody's", "b/x"), (5, "Licensed under the Apache License, Version 2.0.", "c/x"), (5, "Released under the MIT License.", "a/x"), (None, "Licensed under CC BY 4.0.", "d/x"), (6, None, "a/y"), (None, "", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, path string").selectExpr("*", "1 as `key`", "2 as licence", "3 as held", "4 as unit")
    got = sorted((str(r.doc_id), r.path or "", r.licence or "", r.origin) for r in licenses.scan_licenses(table, path=F.col("path")).collect())
    want = [("5", "a/x", "MIT", "notice"), ("5", "a/x", "MIT", "notice"), ("5", "b/x", "", "none"), ("5", "c/x", "Apache-2.0", "notice"), ("6", "a/y", "MIT", "inherited"), ("None", "", "", "none"), ("None", "d/x", "CC-BY-4.0", "notice")]
    assert got == sorted(want)
    assert licenses.scan_licenses(odd).count() == odd.count()


def test_every_template_passes_the_gate():
    for texts in licenses.TEMPLATES.values():
        for text in texts:
            assert re.search(licenses.NOTICE, text) and any(re.search(licenses.NOTICE_WORD, w) for w in re.split(licenses.WORD, text.lower()))


def mixed(rows, share=mixing.BUDGET_SHARE, most=mixing.MAX_EPOCHS):
    """Brute-force mixing: {(id, epoch): times}."""
    words = lambda t: len([w for w in re.split("[ \t\n\r\f\x0b]+", t or "") if w])
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    leaf, held = Counter(), defaultdict(list)
    for r in rows:
        digit = re.search("([0-9])[^0-9]*$", r.source or "")
        k = (f"domain_{int(digit[1]) % 4}" if digit else "domain_x", r.lang, r.source)
        leaf[k] += words(r.text)
        held[k].append(r)
    under = lambda p: sum(v for k, v in leaf.items() if k[: len(p)] == p)
    budget = {(): sum(leaf.values()) * share}
    for depth in range(3):
        for parent in [p for p in budget if len(p) == depth]:
            left = {k[: depth + 1] for k in leaf if k[:depth] == parent and under(k[: depth + 1])}
            weight = {c: 1.0 if depth == 0 else mixing.LANGUAGE_WEIGHTS.get(c[1], mixing.OTHER_WEIGHT) if depth == 1 else math.sqrt(under(c)) for c in left}
            b = budget[parent]
            while left:
                total = sum(weight[c] for c in left)
                full = {c for c in left if most * under(c) <= b * weight[c] / total + 1e-9}
                budget |= {c: most * under(c) if full else b * weight[c] / total for c in (full or left)}
                b -= sum(budget[c] for c in full)
                left = left - full if full else set()
    out = Counter()
    for k, own in held.items():
        if k not in budget:
            continue
        whole = min(int(budget[k] / leaf[k] + 1e-9), most)
        rest, used = int(budget[k] - whole * leaf[k] + 1e-6), 0
        out.update((r.doc_id, e) for r in own for e in range(whole))
        place = lambda r, w=whole: md5(f"{mixing.SEED}|{w}|{'' if r.doc_id is None else r.doc_id}|{md5(r.text or '')}")
        for key in sorted({place(r) for r in own}) if whole < most else ():
            same = [r for r in own if place(r) == key]
            used += sum(words(r.text) for r in same)
            if used > rest:
                break
            out.update((r.doc_id, whole) for r in same)
    return out


def test_mixing(spark, docs, odd):
    for table in (docs, odd):
        got = mixing.mix(table)
        assert Counter((r.doc_id, r.mix_epoch) for r in got.collect()) == mixed(table.select("doc_id", "text", "lang", "source").collect())
        assert got.columns[: len(table.columns)] == table.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_clashing_columns(spark, docs):
    """A column of the documents with the name of an added one is replaced; where none is added it stays."""
    table = docs.selectExpr("*", "'own' as MIX_domain", "7 as mix_epoch", "8 as tokens")
    got = mixing.mix(table)
    assert got.columns == [*docs.columns, "tokens", "mix_domain", "mix_tokens", "mix_epoch"]
    assert Counter((r.doc_id, r.mix_epoch) for r in got.collect()) == mixed(docs.collect())
    plain = mixing.mix(table, added=())
    assert plain.columns == table.columns and {r.MIX_domain for r in plain.collect()} == {"own"}


def test_mixing_by_shuffle(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert Counter((r.doc_id, r.mix_epoch) for r in mixing.mix(docs).collect()) == mixed(docs.collect())


def test_notices_at_any_place_of_an_unbroken_line(spark):
    """Every template after 0, 7, 23 or 50 foreign words and before 60 others, without a line's end to tell it."""
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for name, own in licenses.TEMPLATES.items():
        for text in own:
            for before in (0, 7, 23, 50):
                foreign = [f"w{i}" for i in rng.integers(0, 900, before + 60)]
                i = 100 * len(rows)
                rows.append((i, " ".join([*foreign[:before], *text.split(), *foreign[before:]]), "en", f"s{i}"))
                want[i] = (name, "notice")
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id: (r.licence, r.origin) for r in got} == want


def test_sanitised_texts_are_linear_and_whole(spark):
    """Spans in many blocks of a long text, letters beyond ASCII, spans of different kinds that overlap, repeated and empty rows, no rows."""
    rows = [(1, "é mail a@b.cc and 1.2.3.4, +1 (555) 555-1234 x"), (2, None), (3, ""), (3, ""), (4, "nothing"), (5, "a@b.cc"), (6, "x" * 3000 + " a@b.cc " + "ü" * 2500 + " 10.0.0.1"), (7, "😀" * 1500 + " a@b.cc " + "😀" * 1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in pii.sanitise(docs).where("text is not null").collect())
    assert got == [(1, "é mail [EMAIL] and [IP], [PHONE] x"), (3, ""), (3, ""), (4, "nothing"), (5, "[EMAIL]"), (6, "x" * 3000 + " [EMAIL] " + "ü" * 2500 + " [IP]"), (7, "😀" * 1500 + " [EMAIL] " + "😀" * 1500)]
    assert pii.sanitise(docs).where("text is null").count() == 1 and pii.sanitise(docs.limit(0)).collect() == []
    long = spark.createDataFrame([(1, " ".join(f"user{i}@host{i % 7}.org word" for i in range(3000)))], "doc_id long, text string")
    assert pii.sanitise(long).first().text == " ".join(["[EMAIL] word"] * 3000)
