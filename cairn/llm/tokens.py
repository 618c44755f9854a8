"""Whole-text encoding with a public tokenizer file, fast enough for a scan.

Both files split a text at its white space before merging, so the ids of a text are the ids
of its chunks one after the other. Chunks repeat, so each worker keeps the ids of those it
has met; those not used for long are dropped when there are too many, so memory is bounded. Texts
whose white space is not plainly separable are encoded as they are.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

from cairn.llm import workers

KEPT = 600_000

#: White space beyond the ASCII kinds, and the separators on which Python and the tokenizers disagree.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A space before more white space.
_RUN = re.compile(" [ \n\t\r\x0b\x0c]")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Letters beyond extended Latin, and the one dotted I that lowers to two characters.
_WIDE = re.compile("[\u0130\u0250-\U0010ffff]")
#: A word followed by ASCII marks: the word and the run of marks are encoded apart.
_MARKED = re.compile(r"([^\W\d_]+)([!-/:-@\[-^`{-~]+)").fullmatch


class Encoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, keeps_space: bool, kept: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's to deal out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space, self.kept = keeps_space, kept
        # two generations: the old one is dropped when the young one is full, what was used meanwhile has moved over
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.space = " " if keeps_space else ""
        # a word of letters alone is cut off by its neighbours' spaces: its ids begin with the one that holds the space, or end with the one that ends a word
        edge = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab().items():
            edge[i] = token.startswith("\u0120") if keeps_space else token.endswith("</w>")
        self.edge = edge

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """As _encode of each word after a space, for words of letters: many in one text, cut apart by their edges."""
        out: list[bytes] = []
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([self.space + " ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(part):
                out += self._encode([self.space + w for w in part])
                continue
            cuts = [*edges.tolist(), len(ids)] if self.keeps_space else [0, *(edges + 1).tolist()]
            raw = ids.tobytes()
            out += [raw[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:], strict=False)]
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Make known hold every chunk's ids; those of a word with marks after it are the word's and the marks'."""
        known = self.known
        if len(known) + len(chunks) > self.kept:
            self.old, self.known = known, {}
            known = self.known
        old, words, others, marked = self.old, set(), [], []
        lowers, marked_as = not self.keeps_space, _MARKED
        for c in chunks.difference(known):
            ids = old.get(c)
            if ids is not None:
                known[c] = ids
            elif lowers and "\u0130" in c:  # lowers to two characters, the second of which joins what follows
                others.append(c)
            elif c.isalpha():
                words.add(c)
            elif (m := marked_as(c)) and m[1].isalpha():
                marked.append((c, m[1], m[2]))
                if m[1] not in known:
                    words.add(m[1])
            else:
                others.append(c)
        ordered = list(words)
        known.update(zip(ordered, self._encode_words(ordered), strict=True))
        known.update(zip(others, self._encode([self.space + c for c in others]), strict=True))
        if marked:
            marks = list({m for *_, m in marked}.difference(self.marks))
            self.marks.update(zip(marks, self._encode(marks), strict=True))
            for c, word, mark in marked:
                known[c] = known[word] + self.marks[mark]
        if len(self.marks) > self.kept:
            self.marks.clear()

    def _chunks(self, text: str) -> list[str] | None:
        """The chunks, the first without and the others with a space before them in the text; None if they can't be told."""
        if not self.keeps_space:
            # the file's normaliser lowers too; beyond these letters it may do so in another way
            return None if _SEPARATORS.search(text) else text.split() if _WIDE.search(text) else text.lower().split()
        # a space that is followed by more white space belongs to a run that is split otherwise
        if text[-1:] == " " or _RUN.search(text) or (_SEPARATORS if text.isascii() else _ODD).search(text):
            return None
        return text.split(" ")

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 256):
            part = [t or "" for t in texts[at : at + 256]]
            split = [self._chunks(t) for t in part]
            heads = iter(self._encode([c[0] for c in split if c])) if self.keeps_space else None
            self._learn(set().union(*(c for c in split if c)))
            whole = iter(self._encode([t for t, c in zip(part, split, strict=True) if c is None]))
            get = self.known.__getitem__
            for chunks in split:
                if chunks is None:
                    out.append(next(whole))
                elif heads is None or not chunks:
                    out.append(b"".join(map(get, chunks)))
                else:
                    out.append(next(heads) + b"".join(map(get, chunks[1:])))
        return out


def encoder(name: str, keeps_space: bool, kept: int = KEPT) -> Encoder:
    """The worker's encoder; name is a file of public_tokenizers or a path. At most twice ``kept`` chunks are held, some 200 bytes each."""
    workers.enter("tokens")
    return _encoder(name, keeps_space, kept)


@lru_cache(maxsize=1)
def _encoder(name: str, keeps_space: bool, kept: int) -> Encoder:
    path = name
    if not os.path.isabs(name):
        import public_tokenizers

        path = public_tokenizers.path(name)
    return Encoder(path, keeps_space, kept)


workers.keeps("tokens", _encoder.cache_clear)
