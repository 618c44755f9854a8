"""SimHash near copies: wide fingerprints, covering-code anchors, and an exact check of the shingles.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of
four fifths or more. Words are cut at ASCII white space, A-Z in lower case; a text of fewer
words is one shingle, a text without words has none and links with its like.

Fingerprints. A text has ``TABLES`` SimHash fingerprints of 64 bits over its set of
shingles. At a similarity of 0.8 the sets' cosine is 0.89 or more, so 15 of 100 bits differ
or fewer, a good deal more than the two bits of ``simhash.near_pairs``.

Anchors. Each fingerprint's first 52 bits have a product of two Golay codes and two
repetition codes as anchors, 2^26 of them. As in ``simhash``, a fingerprint goes to every
anchor within the covering radius plus half of ``REACH`` bits, 11 of them. Fingerprints of
one table that differ in REACH bits surely meet; those that differ in more meet by chance,
in one of the tables: 0.96 of the pairs with a similarity of 0.8, 0.99 at 0.85, 0.9998 at 0.9
(a copy is lost only if it meets no text of its group). tests/llm measures it.

Comparing. Where two texts alone share an anchor and another fingerprint is far apart, they met
by chance: of near copies at the limit a fingerprint is so far apart once in 100,000 meetings (of a few words once in 5,000), and
they meet in several tables. The other texts under an anchor are compared with one of them, the head, first by
all bits of their fingerprints, then by their shingles: each text with the head that it meets
most often (heads are texts amid a crowd, those that meet most others), then one pair of each two groups that heads would join, then the pairs that this leaves in
different groups. Texts under one anchor that are still in
different groups are compared with each other, but for those whose shingles leave no room for a link:
what two texts share is at most what each of them has that is found in any other text that it meets.
A text that meets many heads in vain is told by that before it is compared with all of them, and pairs are told by it at the end. A first round does so, but for the last two steps, with
the anchors of four tables; then all tables are laid out, and a text meets only heads of other groups than its own.
So a crowd of copies costs a few rows and comparisons
a member, but those of its texts that link with none of its heads meet all of it. No link is
reported that the shingles don't confirm; of those at the limit, bits lose 1 in 500.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import workers
from cairn.llm.simhash import SEED, anchors
from cairn.operators.components import connected_components
from cairn.session import checkpoint, shuffles_go, text_batches

SHINGLE = 5
TABLES = 20
#: Tables of the first round; whatever it leaves apart meets under all of them.
FIRST_TABLES = 4
REACH = 2
#: (first bit, length, check bits, covering radius) of the code of each block, as in simhash.
BLOCKS = ((0, 23, 11, 3), (23, 23, 11, 3), (46, 3, 2, 1), (49, 3, 2, 1))
#: Most of the 1,280 bits in which the fingerprints of near copies may differ: 194 are expected with a deviation of 13; 240 and 14 for texts of fewer than FEW shingles.
MOST_BITS, MOST_BITS_OF_FEW, FEW = 233, 285, 20
#: Most bits in which another table's fingerprint may differ where only two texts meet: 10 are expected, 12 for a few words, with a deviation of 3; strangers differ in 32.
MOST_SKETCH = 24
#: Shingles whose hashes are mixed at once, whatever the text's length.
MIXED = 4096
#: Texts whose anchors one task makes.
DEALT = 4096
#: Rows to leave out are broadcast up to so many, beyond that joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Texts are heads in order of how many they met in the first round, by fourths of powers of two, above so many bits of the sid.
ORDER_BITS = 50
#: Texts that still meet heads of other groups under so many anchors are asked whether their shingles leave room for a link.
CROWDED = 16


def words(text_col: str = "text") -> Column:
    small = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(small, r"[ \t\n\x0B\f\r]+"), "")


def shingle_hashes(text: str | None) -> np.ndarray:
    """The different shingles' hashes, in order; a text without words has the hash of none."""
    import xxhash

    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    digest = xxhash.xxh64_intdigest
    if len(own) < SHINGLE:
        return np.array([digest(b" ".join(own), SEED)], np.uint64)
    return np.unique(np.array([digest(s, SEED) for s in map(b" ".join, zip(*(own[i:] for i in range(SHINGLE)), strict=False))], np.uint64))


def wide_fingerprint(hashes: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """``tables`` SimHash fingerprints; each table mixes the shingles' hashes in its own way."""
    ones, seeds = np.zeros(64 * tables, np.int64), np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for start in range(0, len(hashes), MIXED):
        with np.errstate(over="ignore"):
            mixed = hashes[start : start + MIXED, None] + seeds[None, :]
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                mixed = (mixed ^ mixed >> np.uint64(shift)) * np.uint64(factor)
            mixed ^= mixed >> np.uint64(31)
        for at in range(0, len(mixed), 128):  # bytes hold counts up to 255
            ones += np.add.reduce(np.unpackbits(mixed[at : at + 128].view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def _fingerprints(texts: DataFrame) -> DataFrame:
    """(sid, f0, f1, ..., few) of rows (sid, text), one row for each sid; few marks texts of fewer than FEW shingles."""
    names = [f"f{t}" for t in range(TABLES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("near copies")
        for batch in batches:
            hashes = [shingle_hashes(t) for t in batch.column(1).to_pylist()]
            made = np.array([wide_fingerprint(h) for h in hashes], np.uint64).reshape(-1, TABLES).view(np.int64)
            few = pa.array([len(h) < FEW for h in hashes], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[:, t]) for t in range(TABLES)), few], names=["sid", *names, "few"])
        workers.give_back()

    made = texts.select("sid", "text").mapInArrow(run, "sid long, " + ", ".join(f"{n} long" for n in names) + ", few boolean")
    return made.groupBy("sid").agg(*(F.any_value(n).alias(n) for n in [*names, "few"]))


def _replicas(prints: DataFrame, labelled: DataFrame, tables: int) -> DataFrame:
    """(key, sid, label, order, sketch) of prints and (sid, label, order): every anchor within reach of the first tables; a key stands for table and anchor, the sketch is the next table's fingerprint. A label is null where a text is in no group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("near copies")
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                sids, orders = (batch.column(n).to_numpy() for n in ("sid", "order"))
                for t in range(tables):
                    fps = batch.column(f"f{t}").to_numpy().view(np.uint64) & np.uint64((1 << 52) - 1)
                    rows, anchor = anchors(fps, REACH, BLOCKS)
                    sketch = batch.column(f"f{(t + 1) % TABLES}").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array((anchor | np.uint64(t << 52)).view(np.int64)), pa.array(sids[rows]), batch.column("label").take(pa.array(rows)), pa.array(orders[rows]), pa.array(sketch[rows])], names=["key", "sid", "label", "order", "sketch"])
        workers.give_back()

    dealt = max(1, -(-labelled.count() // DEALT))
    return prints.join(labelled, "sid").repartition(dealt).mapInArrow(run, "key long, sid long, label long, order long, sketch long")


def _sets(texts: DataFrame) -> DataFrame:
    """(sid, shingles) of rows (sid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("near copies")
        for batch in batches:
            made = [shingle_hashes(t).view(np.int64) for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, made)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*made, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["sid", "shingles"])
        workers.give_back()

    return texts.select("sid", "text").mapInArrow(run, "sid long, shingles array<long>")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose shingles have a similarity of four fifths."""
    a = sets.select(F.col("sid").alias("src"), F.col("shingles").alias("a"))
    b = sets.select(F.col("sid").alias("dst"), F.col("shingles").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    small, large = F.least(F.size("a"), F.size("b")), F.greatest(F.size("a"), F.size("b"))
    return pairs.join(a, "src").join(b, "dst").where(5 * small >= 4 * large).where(9 * shared >= 4 * (small + large)).select("src", "dst")


def _bits(left: str, right: str) -> Column:
    """The bits in which the fingerprints of two rows differ."""
    total = F.lit(0)
    for t in range(TABLES):
        total = total + F.bit_count(F.col(f"{left}{t}").bitwiseXOR(F.col(f"{right}{t}")))
    return total


def _close(bits: Column) -> Column:
    return bits <= F.when(F.col("few_a") | F.col("few_b"), MOST_BITS_OF_FEW).otherwise(MOST_BITS)


def _near(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """pairs (src, dst, ...) with bits, of those that differ in few enough of them."""
    for end, name in (("src", "a"), ("dst", "b")):
        pairs = pairs.join(prints.select(F.col("sid").alias(end), F.col("few").alias(f"few_{name}"), *(F.col(f"f{t}").alias(f"{name}{t}") for t in range(TABLES))), end)
    kept = [c for c in pairs.columns if not (c[0] in "ab" and c[1:].isdigit() or c.startswith("few_"))]
    return pairs.withColumn("bits", _bits("a", "b")).where(_close(F.col("bits"))).select(*kept, "bits")


def _meetings(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """(key, n, sid, head) of the rows (key, sid, label, order, sketch) whose label isn't that of the head, the least by order, of their key of n texts; labelled has (sid, label, order) of all.

    Texts of one order under one anchor are heads together.
    """
    # nearly all keys have one text, so this shuffle is as large as its rows are wide: a text without a group has no label
    # strangers that meet by chance are nearly always two, and these are told by their sketches: the bits in only one of them
    totals = [F.min("order").alias("order"), F.bit_xor("sketch").alias("apart"), F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n"), F.count("label").alias("grouped")]
    shared = rows.groupBy("key").agg(*totals).where(F.expr("n > 1 and (grouped < n or least <> most)") & ((F.col("n") > 2) | (F.bit_count("apart") <= MOST_SKETCH)))
    shared = checkpoint(shared.select("key", "n", "order"))
    few = shared.count() <= BROADCAST_ROWS
    shared = shared.join(labelled.select("order", F.col("sid").alias("head"), F.coalesce("label", "sid").alias("head_label")), "order").drop("order")
    met = rows.select("key", "sid", "label").join(F.broadcast(shared) if few else shared, "key").where("coalesce(label, sid) <> head_label")
    return checkpoint(met.select("key", "n", "sid", "head"))


def _stars(members: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each text's head that it meets most, of those that are near; and of all other heads (src, dst, met), how often a text meets them, which tells how near they are."""
    stars = members.groupBy(F.col("sid").alias("src"), F.col("head").alias("dst")).agg(F.count(F.lit(1)).alias("met"))
    # a text meets no more heads than it has anchors
    stars = checkpoint(stars.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("met"), "dst"))))
    return checkpoint(_near(stars.where("place = 1").select("src", "dst"), prints)).select("src", "dst"), stars.where("place > 1").drop("place")


def _room(sets: DataFrame) -> DataFrame:
    """(sid, size, common) of sets (sid, shingles): a text's shingles, and those of them that any other text has."""
    each = sets.select("sid", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("sid"))
    lonely = each.where("n = 1").groupBy("sid").agg(F.count(F.lit(1)).alias("lonely"))
    return sets.select("sid", F.size("shingles").alias("size")).join(lonely, "sid", "left").select("sid", "size", F.expr("size - coalesce(lonely, 0)").alias("common"))


def _hopeful(members: DataFrame, labelled: DataFrame, texts: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members but for those that can link with none under their key, where crowds meet heads; sets with those that this took.

    Whatever is under a key of a head is in its company: it has the head's label or is one of its members. Two texts of it that
    link share 4/9 of both sizes at least, and at most what either of them has in common with any other of the company.
    """
    crowded = members.withColumn("meetings", F.count(F.lit(1)).over(Window.partitionBy("sid"))).where(F.col("meetings") >= CROWDED)
    own = labelled.select("sid", F.coalesce("label", "sid").alias("label"))
    heads = checkpoint(crowded.select("head").distinct().join(own.withColumnRenamed("sid", "head"), "head"))
    if heads.isEmpty():
        return members, sets
    company = members.join(heads, "head", "left_semi").select("sid").union(own.join(heads, "label", "left_semi").select("sid"))
    company = checkpoint(company.distinct())
    sets = sets.union(_sets_of(texts, company.join(sets, "sid", "left_anti")))
    room = checkpoint(_room(sets.join(company, "sid", "left_semi")))
    sized = checkpoint(members.join(room, "sid", "left"))
    # the smallest text that may be met with each head: among its members, or of its group
    met = sized.groupBy("head").agg(F.min("size").alias("least_met"))
    grouped = room.join(own, "sid").groupBy("label").agg(F.min("size").alias("least_grouped"))
    least = heads.join(met, "head").join(grouped, "label").select("head", F.least("least_met", "least_grouped").alias("least"))
    kept = sized.join(least, "head", "left").where("least is null or 45 * common >= 20 * size + greatest(20 * least, 16 * size)")
    return checkpoint(kept.select("key", "n", "sid", "head")), sets


def _bridges(apart: DataFrame, prints: DataFrame) -> DataFrame:
    """One near pair (src, dst) at most for each two groups that the pairs of _apart would join."""
    sides = [F.col("l_src"), F.col("l_dst")]
    between = apart.groupBy(F.least(*sides).alias("low"), F.greatest(*sides).alias("high")).agg(F.max(F.struct("met", "src", "dst")).alias("m"))
    return _near(between.select("m.src", "m.dst"), prints).select("src", "dst")


def near_copy_groups(texts: DataFrame) -> DataFrame:
    """(node, component) of the texts (sid, text) that have a near copy; a sid may be there more than once, with the same words."""
    text_batches(texts.sparkSession)
    prints = checkpoint(_fingerprints(texts))
    # a first round over few tables joins what is plainly alike, so that a crowd is one group before all its anchors are laid out
    alone = checkpoint(prints.select("sid", F.lit(None).cast("long").alias("label"), F.col("sid").alias("order")))
    members = _meetings(_replicas(prints, alone, FIRST_TABLES), alone)
    near, rest = _stars(members, prints)
    near = checkpoint(near.union(_bridges(_apart(rest, _labels(near)), prints)).distinct())
    sets = _sets_of(texts, _ends(near))
    first = checkpoint(_alike(near, sets))
    # all tables: only texts that are not yet in their head's group meet it
    # and what meets most others is the head wherever it is, so that a crowd has few heads, those amid it
    often = members.groupBy("sid").agg(F.sum("n").alias("often"))
    order = F.expr(f"shiftleft(-cast(coalesce(floor(4 * log2(often)) + 1, 0) as bigint), {ORDER_BITS}) + (sid & {(1 << ORDER_BITS) - 1})")
    alike = _labels(first)
    labelled = alone.select("sid").join(alike, "sid", "left").join(often, "sid", "left")
    labelled = checkpoint(labelled.select("sid", "label", order.alias("order")))
    members, sets = _hopeful(_meetings(_replicas(prints, labelled, TABLES), labelled), labelled, texts, sets)
    near, rest = _stars(members, prints)
    # groups that heads would join are joined by one pair of each two groups; what that leaves apart is compared in full
    supposed = _labels(near, alike)
    apart = checkpoint(_apart(rest, supposed))
    bridges = checkpoint(_bridges(apart, prints))
    supposed = checkpoint(_labels(bridges, supposed))
    tried = checkpoint(_apart(apart.drop("l_src", "l_dst"), supposed).select("src", "dst"))
    near = checkpoint(near.union(bridges).union(_near(tried, prints).select("src", "dst")).distinct().join(first, ["src", "dst"], "left_anti"))
    sets = sets.union(_sets_of(texts, _ends(near.union(rest.select("src", "dst"))).join(sets, "sid", "left_anti")))
    alike = checkpoint(_labels(checkpoint(_alike(near, sets)), alike))
    # pairs that were passed over as their ends were taken for one group, where the shingles say that they aren't
    apart = _apart(rest, alike).drop("l_src", "l_dst")
    again = _near(apart.join(tried, ["src", "dst"], "left_anti").select("src", "dst"), prints).select("src", "dst")
    alike = _labels(checkpoint(_alike(checkpoint(again), sets)), alike)
    # what shares an anchor and is still apart from its head: there all others meet, those of different groups
    labels = checkpoint(alone.select("sid").join(alike, "sid", "left").select("sid", F.coalesce("label", "sid").alias("label")))
    own, heads = labels.withColumnRenamed("label", "l_own"), labels.select(F.col("sid").alias("head"), F.col("label").alias("l_head"))
    split = checkpoint(members.join(own, "sid").join(heads, "head").where("l_own <> l_head").select("key", "head").distinct())
    few = split.count() <= BROADCAST_ROWS
    # these are members, or had the head's label
    heads = split.select(F.col("head").alias("sid")).distinct()
    grouped = labelled.join(labelled.join(heads, "sid").select("label").distinct(), "label", "left_semi").select("sid")
    there = checkpoint(members.select("sid").union(grouped).distinct())
    rows = _replicas(prints, labelled.join(there, "sid", "left_semi"), TABLES)
    left = rows.select("key", "sid").join(F.broadcast(split) if few else split, "key").where("sid <> head").select("key", "sid").distinct()
    left = checkpoint(left.join(labels, "sid"))
    split = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    left = checkpoint(left.join(split, "key"))
    present = checkpoint(left.select("sid").distinct())
    sets = sets.union(_sets_of(texts, present.join(sets, "sid", "left_anti")))
    room = _room(sets.join(present, "sid", "left_semi")).where("5 * common >= 4 * size")
    left = checkpoint(left.join(prints.join(room, "sid"), "sid"))
    renamed = lambda end, at: left.select("key", F.col("sid").alias(end), F.col("label").alias(f"l{at}"), F.col("size").alias(f"size_{at}"), F.col("common").alias(f"common_{at}"), F.col("few").alias(f"few_{at}"), *(F.col(f"f{t}").alias(f"{at}{t}") for t in range(TABLES)))
    able = F.expr("src < dst and la <> lb and 9 * least(common_a, common_b) >= 4 * (size_a + size_b)")
    pairs = renamed("src", "a").join(renamed("dst", "b"), "key").where(able & _close(_bits("a", "b"))).select("src", "dst")
    pairs = checkpoint(pairs.distinct())
    return _labels(_alike(pairs, sets), alike).select(F.col("sid").alias("node"), F.col("label").alias("component"))


def _ends(pairs: DataFrame) -> DataFrame:
    """(sid) of both ends of the pairs (src, dst), each once."""
    return pairs.select(F.col("src").alias("sid")).union(pairs.select("dst")).distinct()


def _sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, shingles) of the wanted (sid), one row for each; the texts are read only if one is wanted."""
    wanted = checkpoint(wanted)
    if wanted.isEmpty():
        return texts.sparkSession.createDataFrame([], "sid long, shingles array<long>")
    return checkpoint(_sets(texts.join(wanted, "sid", "left_semi")).groupBy("sid").agg(F.any_value("shingles").alias("shingles")))


def _labels(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(sid, label) of the texts that edges (src, dst) or the groups before link; these are stars, which cost no rounds."""
    if before is not None:
        edges = edges.select("src", "dst").union(before.select("sid", "label"))
    return connected_components(edges).select(F.col("node").alias("sid"), F.col("component").alias("label"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (src, dst, ...) whose ends are in different groups, with the groups as l_src and l_dst."""
    for end in ("src", "dst"):
        pairs = pairs.join(labels.select(F.col("sid").alias(end), F.col("label").alias(f"l_{end}")), end, "left")
    pairs = pairs.withColumns({"l_src": F.coalesce("l_src", "src"), "l_dst": F.coalesce("l_dst", "dst")})
    return pairs.where("l_src <> l_dst")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each group of near copies: the one with the smallest id.

    Of rows that share that id and words one stays, whichever. Of groups without a known id
    one row of one text stays. Null text counts as empty; texts without words are a group;
    an empty table gives no rows; other columns are kept, whatever their names.
    """
    kept = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("_id"), *(F.col(c).alias(k) for c, k in zip(docs.columns, kept, strict=True)))
    rows = rows.withColumn("sid", F.xxhash64(words("text")))
    with shuffles_go(docs.sparkSession):  # all that is large in it is written there
        groups = near_copy_groups(rows.select("sid", "text")).withColumnRenamed("node", "sid")
    narrow = checkpoint(rows.groupBy("_id", "sid").agg(F.count(F.lit(1)).alias("copies")))
    labelled = checkpoint(narrow.join(groups, "sid", "left").select("_id", "sid", "copies", F.coalesce("component", "sid").alias("label")))
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("sid").alias("s"))).alias("m")).select("label", "m.id", "m.s")
    judged = labelled.join(first, "label").withColumn("stays", F.col("_id").eqNullSafe(F.col("id")) & (F.col("sid") == F.col("s")))
    judged = checkpoint(judged.where("not stays or copies > 1").select(F.col("_id").alias("_of"), F.col("sid").alias("_sid"), "stays"))
    own = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("sid") == F.col("_sid"))
    beside = F.broadcast if judged.count() <= BROADCAST_ROWS else lambda df: df
    rows = rows.drop("text")
    alone = rows.join(beside(judged), own, "left_anti")
    repeated = judged.where("stays")
    out = alone if repeated.isEmpty() else alone.union(rows.join(beside(repeated), own, "left_semi").dropDuplicates(["_id", "sid"]))
    return out.select(*(F.col(k).alias(c) for c, k in zip(docs.columns, kept, strict=True)))
