"""Toxicity of texts: gradient-boosted trees over dense features, isotonically calibrated.

Lexicon. Terms are words (with look-alike digits and signs undone, inner marks dropped and
long repeats shortened) and their first four and five letters, which stand for the forms of
an inflected word. A term's weight is its smoothed log-odds between toxic and clean training
texts. A short list of plain insults is known from the start.

Features. Densities and extremes of the lexicon weights, second-person words and how close
the nearest lexicon term is to one, shares of capitals, of shouted words, punctuation and
exclamation marks, digits, repeated words, obfuscated words, and length.

Fitting uses about ``MAX_FIT_ROWS`` labelled rows at most, chosen by a hash of the id; their
ids and labels are broadcast, so no text is shuffled. They are split by ``fold`` 1 to 4: a
text is described by the term counts of the other folds, so no text sees its own label. The
trees are fitted on folds 1 to 3 and the isotonic calibration on fold 4. Scoring uses the
counts of all folds and covers every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import workers
from cairn.session import checkpoint, text_batches

MAX_FIT_ROWS = 40_000
LEAST_TOXIC = 3
FOLDS = 4
TREES = 24
DEPTH = 4

#: Insults known without labels, and second-person words of the four languages.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "fool", "jerk", "bastard", "bitch", "shit", "fuck", "asshole", "dumb", "ugly", "hate", "kill", "idiota", "imbécil", "estúpido", "mierda", "puta", "dummkopf", "arschloch", "blöd", "scheiße", "crétin", "connard", "salaud", "merde", "débile")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros")
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasil")

FEATURES = ("words", "hits_strong", "hits_weak", "density_strong", "density_weak", "max_word", "max_prefix5", "max_prefix4", "sum_positive", "insults", "second_person", "nearest", "capitals", "shouted", "punctuation", "exclamations", "digits", "non_letters", "obfuscated", "obfuscated_hits", "repeats", "mean_length", "longest_run", "mean_weight")

_LETTERS = re.compile(r"[^\W\d_]+")
_REPEAT = re.compile(r"(.)\1{2,}")
_EDGE = ".,;:!?\"'()[]{}*#&%$|<>-_"


@lru_cache(maxsize=200_000)
def _normal(token: str) -> tuple[str, bool]:
    """(term, obfuscated) of a token between white space; term is empty if it has no letter."""
    plain = token.strip(_EDGE).lower()
    if plain.isalpha():
        short = _REPEAT.sub(r"\1\1", plain) if len(plain) > 3 else plain
        return short, short != plain
    if not any(c.isalpha() for c in plain):
        return "", False
    undone = "".join(_LETTERS.findall(plain.translate(LOOK_ALIKE)))
    return _REPEAT.sub(r"\1\1", undone), True


workers.keeps("toxicity", _normal.cache_clear)


def _terms(text: str | None) -> set[str]:
    """The lexicon terms of a text: w:word, 5:prefix and 4:prefix."""
    out: set[str] = set()
    for token in set((text or "").split()):
        word, _ = _normal(token)
        if len(word) > 2:
            out.add("w:" + word)
            if len(word) > 5:
                out.add("5:" + word[:5])
            if len(word) > 4:
                out.add("4:" + word[:4])
    return out


def term_counts(labelled: DataFrame) -> DataFrame:
    """(term, toxic_1, clean_1, ...) over labelled (text, toxic, fold): documents with the term by label and fold; those with LEAST_TOXIC toxic ones and a third of toxic ones.

    Each holds for the term alone, so the lexicon is bounded by the words of the MAX_FIT_ROWS learned texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("toxicity")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [_terms(t) for t in part.column(0).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([pa.array([t for s in sets for t in s], pa.string()), part.column(1).take(of), part.column(2).take(of)], names=["term", "toxic", "fold"])

    terms = labelled.select("text", F.col("toxic").cast("int"), F.col("fold").cast("int")).mapInArrow(run, "term string, toxic int, fold int")
    counts = [F.count_if((F.col("toxic") == label) & (F.col("fold") == fold)).alias(f"{name}_{fold}") for fold in range(1, FOLDS + 1) for name, label in (("toxic", 1), ("clean", 0))]
    total = sum((F.col(f"toxic_{f}") for f in range(2, FOLDS + 1)), F.col("toxic_1"))
    clean = sum((F.col(f"clean_{f}") for f in range(2, FOLDS + 1)), F.col("clean_1"))
    return terms.groupBy("term").agg(*counts).where((total >= LEAST_TOXIC) & (total * 2 > clean))


class Lexicon:
    """Log-odds of the terms, leaving one fold out (0: none)."""

    def __init__(self, rows: list, totals: list) -> None:
        t, c = np.array([[r[f"toxic_{f}"] for f in range(1, FOLDS + 1)] for r in rows], float).reshape(-1, FOLDS), np.array([[r[f"clean_{f}"] for f in range(1, FOLDS + 1)] for r in rows], float).reshape(-1, FOLDS)
        n = np.array(totals, float)  # (fold, [clean, toxic])
        self.weights: list[dict[str, float]] = []
        for out in range(FOLDS + 1):
            keep = np.arange(1, FOLDS + 1) != out
            toxic, clean = t[:, keep].sum(1), c[:, keep].sum(1)
            n_clean, n_toxic = n[keep].sum(0)
            prior = (n_toxic + 1) / (n_clean + 1)
            weight = np.log((toxic + 0.5 * prior) / (clean + 0.5)) - np.log(prior)
            weight[toxic < LEAST_TOXIC - (out > 0)] = 0
            known = dict(zip((r["term"] for r in rows), weight.tolist(), strict=True))
            for word in INSULTS:
                known[f"w:{word}"] = max(known.get(f"w:{word}", 0.0), 3.0)
            self.weights.append(known)

    def features(self, text: str | None, out: int = 0) -> list[float]:
        """FEATURES of a text."""
        weights, text = self.weights[out], text or ""
        tokens = text.split()
        n = len(tokens)
        strong = weak = insults = second = obfuscated = obfuscated_hits = repeats = shouted = letters = run = longest = 0
        max_word = max_5 = max_4 = total = positive = 0.0
        nearest, last_you, last_hit, previous = 64, -1000, -1000, ""
        get = weights.get
        for i, token in enumerate(tokens):
            word, odd = _normal(token)
            run = run + 1 if token == previous else 0
            repeats += run > 0
            longest = max(longest, run)
            previous = token
            if not word:
                continue
            letters += len(word)
            obfuscated += odd
            shouted += len(word) > 1 and token.isupper()
            if word in _YOU:
                second += 1
                last_you = i
                nearest = min(nearest, i - last_hit)
                continue
            if len(word) < 3:
                continue
            w, p5, p4 = get("w:" + word, 0.0), get("5:" + word[:5], 0.0) if len(word) > 5 else 0.0, get("4:" + word[:4], 0.0) if len(word) > 4 else 0.0
            best = max(w, p5, p4)
            max_word, max_5, max_4 = max(max_word, w), max(max_5, p5), max(max_4, p4)
            if best > 0:
                positive += best
                total += 1
                if best > 1.5:
                    weak += 1
                    if best > 3:
                        strong += 1
                        obfuscated_hits += odd
                        last_hit = i
                        nearest = min(nearest, i - last_you)
            insults += word in _INSULTS
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        kinds = np.bincount(_KIND[raw], minlength=5) if len(raw) else np.zeros(5, int)
        size = max(1, len(raw))
        per = max(1, n)
        return [float(n), strong, weak, 1000 * strong / per, 1000 * weak / per, max_word, max_5, max_4, positive, insults, 1000 * second / per, nearest, kinds[0] / size, shouted / per, kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size, obfuscated / per, obfuscated_hits, repeats / per, letters / per, longest, positive / max(1, total)]


_YOU, _INSULTS = frozenset(SECOND_PERSON), frozenset(INSULTS)
#: What a byte is: 0 a capital, 1 punctuation, 2 an exclamation mark, 3 a digit, 4 not a letter, else 5.
_KIND = np.full(256, 5, np.int64)
for _byte in range(128):
    _c = chr(_byte)
    _KIND[_byte] = 0 if _c.isupper() else 2 if _c == "!" else 3 if _c.isdigit() else 5 if _c.islower() or _c.isspace() else 1 if _c.isprintable() else 4


def _described(rows: DataFrame, lexicon, columns: list[str]) -> DataFrame:
    """columns of rows plus features; uses rows' text and fold."""
    from pyspark.ml.functions import array_to_vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("toxicity")
        own = lexicon.value
        for batch in batches:
            made = [x for t, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in own.features(t, f)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(made, pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], lists], names=[*columns, "features"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    out = rows.select(F.col("text").alias("_text"), F.col("fold").alias("_fold"), *columns).mapInArrow(run, f"{kinds}, features array<double>")
    return out.withColumn("features", array_to_vector("features"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted, raw), one row per row of docs; raw is the trees' own probability, which the calibration turns into score.

    Labels are learned from the rows of docs that ``labels`` (id_col, toxic 0 or 1) covers
    and whose crc32 of the id, as text, leaves a remainder by 5 other than 0; held_out marks
    that remainder. A label is one row: where an id has several, the highest counts; null
    labels and ids are not learned from. Null and empty texts are scored like any other.
    Where no toxic or no clean row can be learned from, every score is the insults' share of
    the words; where only fold 4 lacks one of the labels, it is the trees' own probability,
    uncalibrated. An empty table gives no rows. Other columns are ignored.
    """
    scored = _scored(docs.select(id_col, text_col), labels, id_col, text_col, carried=[id_col])
    return scored.select(F.col("_c0").alias(id_col), (F.col("remainder") == 0).alias("held_out"), "score", "predicted", "raw")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score_toxicity predicts to be toxic; scored in place, so no text is shuffled."""
    scored = _scored(docs, labels, id_col, text_col, carried=docs.columns)
    return scored.where("predicted = 0").select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """_c0, _c1, ... (the carried columns of docs), remainder, score, predicted and raw."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    spark = docs.sparkSession
    text_batches(spark)
    kept = [f"_c{i}" for i in range(len(carried))]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), *(F.col(c).alias(k) for c, k in zip(carried, kept, strict=True)))
    rows = rows.withColumn("remainder", F.coalesce(F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(5)), F.lit(0)).cast("int"))
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(share < F.lit(MAX_FIT_ROWS / max(1, known.count())))
    learn = checkpoint(rows.select("_id", "text", "remainder").where("remainder > 0").join(F.broadcast(sample), "_id").withColumnRenamed("remainder", "fold"))
    sums = {(r["fold"], r["toxic"]): r["count"] for r in learn.groupBy("fold", "toxic").count().collect()}
    totals = [[sums.get((f, label), 0) for label in (0, 1)] for f in range(1, FOLDS + 1)]
    lexicon = spark.sparkContext.broadcast(Lexicon(term_counts(learn).collect(), totals))
    scored = _described(rows.withColumn("fold", F.lit(0)), lexicon, ["remainder", *kept])
    if not all(any(t[label] for t in totals[:3]) for label in (0, 1)):
        share = F.least(F.lit(1.0), vector_to_array("features")[FEATURES.index("insults")] / F.greatest(F.lit(1.0), vector_to_array("features")[0]))
        return scored.select("remainder", *kept, share.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("raw", F.col("score"))
    examples = checkpoint(_described(learn, lexicon, ["_id", "fold", "toxic"]).withColumn("label", F.col("toxic").cast("double")))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=48, minInstancesPerNode=2, featuresCol="features", labelCol="label", cacheNodeIds=True).fit(examples.where("fold < 4"))
    raw = vector_to_array("probability")[1]
    if all(totals[3]):
        held = trees.transform(examples.where("fold = 4")).groupBy(raw.alias("raw")).agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
        calibrated = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(held)
        scored = calibrated.setFeaturesCol("raw").setPredictionCol("score").transform(trees.transform(scored).withColumn("raw", raw))
    else:
        scored = trees.transform(scored).withColumn("raw", raw).withColumn("score", F.col("raw"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select("remainder", *kept, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "raw")
