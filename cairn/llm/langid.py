"""Language identification by unigram piece models, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability for
every piece, from its counts over all labelled training texts (words cut by the
vocabulary's own tokenizer, add-``SMOOTHING``). A word's likelihood is the sum over all its
segmentations into pieces of the product of their probabilities; the forward algorithm
computes it from left to right. A text's likelihood is the product of its words'. Texts and
words are scored whole. Up to ``SHORT`` characters the sums are kept as they are, beyond
that as logarithms, so no number of improbable pieces can make them vanish.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import workers
from cairn.session import text_batches

VOCABULARY = "piece_bpe_32k.model"
SMOOTHING = 0.1
#: A product of so many probabilities of 1e-16 is still a number.
SHORT = 16
#: Words up to so many characters are remembered.
REMEMBERED = 256
KEPT = 1_000_000
UNKNOWN = "und"


@lru_cache(maxsize=2)
def _pieces(name: str):
    """(tokenizer, id of each piece, every end of a piece with the id of the piece it is, or -1) of a public vocabulary or a path."""
    import sentencepiece

    path = name
    if not os.path.isabs(name):
        import public_tokenizers

        path = public_tokenizers.path(name)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    ids = {model.id_to_piece(i): i for i in plain}
    return model, ids, {p[n:]: -1 for p in ids for n in range(1, len(p))} | ids


workers.keeps("langid", _pieces.cache_clear)


def piece_counts(learn: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(lang, piece, n) over all rows of learn (text, lang); piece -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("langid")
        model, _, _ = _pieces(vocabulary)
        words: dict[str, Counter] = {}
        texts: Counter = Counter()

        def rows(langs: list[str], pieces, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.int32()), pa.array(n, pa.int64())], names=["lang", "piece", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in words.items():
                total = np.zeros(model.get_piece_size(), np.int64)
                keys = list(own)
                for at in range(0, len(keys), 20_000):
                    part = keys[at : at + 20_000]
                    cut = model.encode(part, num_threads=1)
                    np.add.at(total, [p for c in cut for p in c], np.repeat([own[w] for w in part], [len(c) for c in cut]))
                used = np.flatnonzero(total)
                yield rows([lang] * len(used), used, total[used])
            words.clear()

        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts[lang] += 1
                words.setdefault(lang, Counter()).update((text or "").split())
            if sum(map(len, words.values())) > KEPT:
                yield from flush()
        yield from flush()
        yield rows(list(texts), [-1] * len(texts), list(texts.values()))

    return learn.select("text", "lang").mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class PieceModel:
    """Piece probabilities by language; score(texts) gives the log-likelihoods of whole texts."""

    def __init__(self, counts: list, vocabulary: str = VOCABULARY) -> None:
        self.vocabulary = vocabulary
        self.langs = sorted({r["lang"] for r in counts})
        size = _pieces(vocabulary)[0].get_piece_size()
        n, texts = np.zeros((size, len(self.langs))), np.zeros(len(self.langs))
        for r in counts:
            if r["piece"] < 0:
                texts[self.langs.index(r["lang"])] = r["n"]
            else:
                n[r["piece"], self.langs.index(r["lang"])] = r["n"]
        self.prob = (n + SMOOTHING) / (n + SMOOTHING).sum(0)
        self.floor = self.prob.min(0).min()  # of a character that no piece holds, in every language
        self.prior = np.log((texts + 1) / (texts + 1).sum())
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": {}, "table": np.zeros((0, len(self.langs)))}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log of the sum over all segmentations, for each word and language.

        The forward algorithm over a tree of beginnings: words in order share the sums of
        the beginnings they have in common, and each depth of the tree is one step for all.
        """
        _, _, ends = _pieces(self.vocabulary)
        get, nodes, depth, last = ends.get, [0], [0], ""
        target, source, piece, final = [], [], [], np.zeros(len(words), np.int64)
        for w in sorted(range(len(words)), key=words.__getitem__):
            word = words[w]
            common, most = 0, min(len(word), len(last))
            while common < most and word[common] == last[common]:
                common += 1
            del nodes[common + 1 :]
            for stop in range(common + 1, len(word) + 1):
                node = len(depth)
                nodes.append(node)
                depth.append(stop)
                if get(word[stop - 1], -1) < 0:  # a character that is no piece
                    target.append(node)
                    source.append(nodes[stop - 1])
                    piece.append(-1)
                for start in range(stop - 1, -1, -1):
                    p = get(word[start:stop])
                    if p is None:
                        break
                    if p >= 0:
                        target.append(node)
                        source.append(nodes[start])
                        piece.append(p)
            final[w] = nodes[-1]
            last = word
        target, source, piece, depth = (np.array(x, np.int64) for x in (target, source, piece, depth))
        order = np.argsort(depth[target], kind="stable")
        target, source, piece = target[order], source[order], piece[order]
        cuts = np.searchsorted(depth[target], np.arange(1, depth.max() + 2))
        table = np.vstack([self.prob, np.full(len(self.langs), self.floor)])  # -1 is the last row
        logs = depth.max() > SHORT + 1
        if logs:
            table = np.log(table)
        alpha = np.zeros((len(depth), len(self.langs)))
        alpha[0] = 0 if logs else 1
        for a, b in zip(cuts, cuts[1:], strict=False):
            first = np.flatnonzero(np.r_[True, target[a + 1 : b] != target[a : b - 1]])
            if logs:
                terms = alpha[source[a:b]] + table[piece[a:b]]
                most = np.maximum.reduceat(terms, first, axis=0)
                terms = np.exp(terms - np.repeat(most, np.diff(np.r_[first, b - a]), axis=0))
                alpha[target[a:b][first]] = most + np.log(np.add.reduceat(terms, first, axis=0))
            else:
                alpha[target[a:b][first]] = np.add.reduceat(alpha[source[a:b]] * table[piece[a:b]], first, axis=0)
        return alpha[final] if logs else np.log(alpha[final])

    def _scored(self, words: list[str]) -> np.ndarray:
        """word_scores of the words, some at a time and those of more than SHORT characters apart."""
        short = np.array([len(w) <= SHORT for w in words], bool)
        out = np.zeros((len(words), len(self.langs)))
        for own in (np.flatnonzero(short), np.flatnonzero(~short)):
            at = 0
            while at < len(own):
                stop, size = at, 0
                while stop < len(own) and stop - at < 20_000 and size < 1_000_000:
                    size += len(words[own[stop]])
                    stop += 1
                out[own[at:stop]] = self.word_scores(["▁" + words[i] for i in own[at:stop]])
                at = stop
        return out

    def _learn(self, words: set[str]) -> None:
        if len(self.rows) + len(words) > KEPT:
            self.rows, self.table = {}, self.table[:0]
        new = sorted(words.difference(self.rows))
        if not new:
            return
        made = self._scored(new)
        for word in new:
            self.rows[word] = len(self.rows)
        if len(self.rows) > len(self.table):  # grow by doubling
            grown = np.zeros((2 * len(self.rows), len(self.langs)))
            grown[: len(self.table)] = self.table
            self.table = grown
        self.table[len(self.rows) - len(new) : len(self.rows)] = made

    def score(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Log-likelihoods with the prior, None for texts without a letter."""
        for at in range(0, len(texts), 256):
            split = [t.split() if t and any(map(str.isalpha, t)) else None for t in texts[at : at + 256]]
            known: set[str] = set().union(*(s for s in split if s))
            long = sorted(w for w in known if len(w) > REMEMBERED)
            self._learn(known.difference(long))
            apart = dict(zip(long, self._scored(long), strict=True))
            get = self.rows.__getitem__
            for words in split:
                if words is None:
                    yield None
                    continue
                plain = [w for w in words if len(w) <= REMEMBERED] if long else words
                total = self.prior + self.table[list(map(get, plain))].sum(0)
                yield total + sum(apart[w] for w in words if len(w) > REMEMBERED) if long else total


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, held_out, lang_pred, score), one row per row of docs.

    Languages are learned from the rows with a non-null lang_col whose crc32 of the id, as
    text, leaves a remainder by 4 other than 2; held_out marks that remainder, and rows with
    a null id are learned from. score is the posterior of the predicted language; equal
    posteriors go to the first language by name. Text that is null or has no letter gives
    ``und`` with score 0, as does every text where there is nothing to learn from. Repeated
    rows are rows of their own; other columns are ignored; an empty table gives no rows.
    The model has one column per language, so it is bounded by the number of languages.
    """
    spark = docs.sparkSession
    text_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = docs.select(F.col(id_col).alias("_id"), held.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = piece_counts(rows.where(~F.col("held_out") & F.col("lang").isNotNull()), vocabulary).collect()
    model = spark.sparkContext.broadcast(PieceModel(counts, vocabulary)) if counts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.enter("langid")
        for batch in batches:
            langs, scores = [], []
            for own in model.value.score(batch.column(2).to_pylist()) if model else [None] * batch.num_rows:
                best = None if own is None else int(own.argmax())
                langs.append(UNKNOWN if own is None else model.value.langs[best])
                scores.append(0.0 if own is None else float(1 / np.exp(own - own[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    return rows.drop("lang").mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
