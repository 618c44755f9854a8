"""Mixing sources to target weights by hierarchical budgets.

The tree has the levels domain, language and source. A node's weight is its share among its
siblings; a subtree can supply its tokens as often as ``max_epochs``. The budget is dealt
out from the root: at every node the children get their share of its budget, and what a
child cannot supply goes to its siblings in proportion to their weights, before anything
goes back up, because a node's budget never exceeds what its subtree can supply. That is
water-filling, and its level has a closed form over the children ordered by capacity per
weight, so each level is one pass of window sums over rows of the tree.

A leaf's documents are read in seeded epochs: epoch e orders them by md5(seed, e, id). The
leaf gets whole epochs while its budget lasts, then the longest prefix of the next epoch
whose tokens fit. The prefix is cut by a cascade: token sums by the first digits of the
order key choose one of 256 parts, those by the next digits one part of it, and only the
last part's documents are ordered one by one. So a leaf with a third of all documents is
never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import checkpoint

SEED = 17
MAX_EPOCHS = 2
BUDGET_SHARE = 0.8
#: Hexadecimal digits of the order key by which a leaf's cut is narrowed: 256 sums a step, then a 2^24th of the documents.
CUT_DIGITS = (2, 4, 6)
#: Leaves are broadcast up to so many, beyond that joined by a shuffle on leaf and bucket.
BROADCAST_LEAVES = 10_000

#: Weights by language, relative to each other; any other language has OTHER_WEIGHT.
LANGUAGE_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
OTHER_WEIGHT = 0.05

LEAF = ("domain", "lang", "source")


def default_domain(source: Column) -> Column:
    """Four domains by the last digit of the source's name; names without digits are one more."""
    digit = F.regexp_extract(source, "([0-9])[^0-9]*$", 1)
    return F.when(digit == "", F.lit("domain_x")).otherwise(F.concat(F.lit("domain_"), F.pmod(digit.try_cast("int"), F.lit(4)).cast("string")))


def default_weights(level: str, tokens: Column) -> Column:
    """A node's weight: domains equal, languages from the table, sources by the square root of their tokens."""
    if level == "domain":
        return F.lit(1.0)
    if level == "lang":
        pairs = [x for k, v in LANGUAGE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]
        return F.coalesce(F.create_map(*pairs)[F.col("lang")], F.lit(OTHER_WEIGHT))
    return F.sqrt(tokens)


def tokens_of(text: Column) -> Column:
    """Words between ASCII white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r\f\x0b"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[ \t\n\r\f\x0B]+"))).cast("long")


def budgets(leaves: DataFrame, budget: float, weights=default_weights) -> DataFrame:
    """leaves (domain, lang, source, tokens, capacity) with ``budget``: their tokens after dealing ``budget`` out from the root."""
    level = leaves.withColumn("parent_budget", F.lit(float(budget)))
    for depth, name in enumerate(LEAF):
        node, above = list(LEAF[: depth + 1]), list(LEAF[:depth])
        nodes = level.groupBy(*node, "parent_budget").agg(F.sum("tokens").alias("tokens"), F.sum("capacity").cast("double").alias("capacity"))
        nodes = nodes.where("capacity > 0").withColumn("weight", weights(name, F.col("tokens")).cast("double")).withColumn("ratio", F.col("capacity") / F.col("weight"))
        siblings = Window.partitionBy(*(above or [F.lit(0)])).orderBy("ratio", name)
        before = siblings.rowsBetween(Window.unboundedPreceding, -1)
        onward = siblings.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        whole = Window.partitionBy(*(above or [F.lit(0)]))
        # if all before are full, those from here on share the rest by weight: this one is full if its ratio is no higher
        water = (F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
        nodes = nodes.withColumn("water", water).withColumn("full", F.col("ratio") <= F.col("water"))
        final = F.min(F.when(~F.col("full"), F.struct("ratio", name, "water"))).over(whole)["water"]
        nodes = nodes.withColumn("own", F.when(F.col("full"), F.col("capacity")).otherwise(F.col("weight") * final))
        level = level.drop("parent_budget").join(nodes.select(*(F.col(c).alias(f"_{c}") for c in node), F.col("own").alias("parent_budget")), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in node]).drop(*(f"_{c}" for c in node))
    return level.withColumnRenamed("parent_budget", "budget")


def _order_key(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_text_hash")).cast("binary"))


#: The columns that mix adds.
ADDED = ("mix_domain", "mix_tokens", "mix_epoch")


def mix(docs: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", domain=default_domain, weights=default_weights, added: tuple[str, ...] = ADDED) -> DataFrame:
    """The chosen rows of docs with all columns, and mix_domain, mix_tokens and mix_epoch; one row per document and epoch.

    The budget is budget_share of the tokens of docs (1 or less can be met). Null languages
    and sources are nodes of their own. Documents without words cost nothing and are chosen
    once per whole epoch, and in the last one if their place is before the cut; a leaf
    without any words has no budget and is left out. The rows of equal ids and texts are
    told apart by nothing, so they share their place: they are chosen or left together.
    ``added`` names the columns to add, of those three; a column of docs with such a name, in
    whatever case, is replaced by it, and any other column keeps its name and place. An
    empty table gives no rows.
    """
    columns = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(F.struct(*(F.col(c) for c in columns)).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    rows = rows.withColumn("domain", F.coalesce(domain(F.col("source")), F.lit("domain_x"))).withColumn("tokens", tokens_of(F.col("_text"))).withColumn("_text_hash", F.md5(F.coalesce("_text", F.lit("")).cast("binary")))
    rows = rows.withColumn("leaf", F.to_json(F.struct(*LEAF)))
    narrow = checkpoint(rows.select("_id", "_text_hash", "tokens", "leaf", *LEAF))
    leaves = narrow.groupBy("leaf", *LEAF).agg(F.sum("tokens").alias("tokens")).withColumn("capacity", F.col("tokens") * max_epochs)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    whole = F.least(F.floor(F.col("budget") / F.col("tokens") + 1e-9), F.lit(max_epochs)).cast("int")
    dealt = budgets(leaves, total * budget_share, weights).withColumn("whole", whole)
    dealt = checkpoint(dealt.select("leaf", "whole", F.floor(F.col("budget") - F.col("whole") * F.col("tokens") + 1e-6).cast("long").alias("rest")))
    small = dealt.count() <= BROADCAST_LEAVES
    beside = F.broadcast if small else lambda df: df
    keyed = narrow.join(beside(dealt), "leaf").select("leaf", "tokens", "rest", _order_key(F.col("whole"), seed).alias("key"))
    cut, digits = dealt.select("leaf", F.lit("").alias("part"), F.lit(0).cast("long").alias("before")), 0
    for more in CUT_DIGITS:
        inside = keyed.withColumn("part", F.substring("key", 1, digits)).join(beside(cut), ["leaf", "part"])
        sums = inside.groupBy("leaf", "rest", "before", F.substring("key", 1, more).alias("part")).agg(F.sum("tokens").alias("n"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("leaf").orderBy("part"))
        first = sums.withColumn("upto", upto).where("upto > rest").groupBy("leaf").agg(F.min(F.struct("part", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
        cut, digits = checkpoint(first.select("leaf", "cut.part", "cut.before")), more
    own = keyed.withColumn("part", F.substring("key", 1, digits)).join(beside(cut), ["leaf", "part"]).groupBy("leaf", "rest", "before", "key").agg(F.sum("tokens").alias("n"))
    until = F.col("before") + F.sum("n").over(Window.partitionBy("leaf").orderBy("key"))
    limits = own.withColumn("until", until).where("until > rest").groupBy("leaf").agg(F.min("key").alias("limit"))
    plan = checkpoint(dealt.join(limits, "leaf", "left").select("leaf", "whole", "limit"))
    chosen = rows.join(beside(plan), "leaf")
    last = F.col("limit").isNull() | (_order_key(F.col("whole"), seed) < F.col("limit"))
    epochs = F.col("whole") + F.when((F.col("whole") < max_epochs) & last, 1).otherwise(0)
    chosen = chosen.withColumn("n_epochs", epochs).where("n_epochs > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("n_epochs") - 1)))
    made = {"mix_domain": F.col("domain"), "mix_tokens": F.col("tokens"), "mix_epoch": F.col("_epoch")}
    return chosen.select("_row.*", *(made[c].alias(c) for c in added))
