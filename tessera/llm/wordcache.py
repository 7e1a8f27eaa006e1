"""Fast whole-text encoding with the ``tokenizers`` library.

Both vocabularies split a text into pre-tokens before any merge, and a pre-token's ids don't depend on its neighbours.
So a batch is cut into pre-tokens with array operations, the library encodes each distinct pre-token once, and the
ids are put together again by array look-ups. The cutting rules are exact for the code points in ``_CLASS`` (Latin
letters, digits, ASCII and general punctuation, blank, tab and line breaks); any document with another code point goes
through the library as a whole. A cached pre-token is found by one 64-bit hash and checked by a second one; a document
where they disagree goes through the library too.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import repeat

import numpy as np

from tessera.llm.textspans import span_hashes
from tessera.llm.worker import kept

_SPACE, _LETTER, _DIGIT, _OTHER, _RARE = range(5)
#: The contractions of both pre-tokenizers.
_SUFFIXES = ("s", "t", "m", "d", "re", "ve", "ll")
#: Distinct pre-tokens kept by a worker; beyond that the table starts anew. Bounds memory, never results.
CACHE_WORDS = 700_000


def _classes() -> np.ndarray:
    out = np.full(0x2100, _RARE, np.uint8)
    for c in [*range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), 0x20AC]:
        kind = unicodedata.category(chr(c))
        out[c] = _LETTER if kind[0] == "L" else _DIGIT if kind[0] == "N" else _OTHER
    out[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
    out[[0x130, 0xAD]] = _RARE  # a lower case of two code points; a format character
    return out


_CLASS = _classes()


class WordEncoder:
    """Encodes batches of texts to one flat id array; ``kind`` is "byte" or "word" for the two pre-tokenizers."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.line_break = vocabulary.get("\u010a", -1)
        self.word_end = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.lengths = np.zeros(1024, np.int64)
        self.begins = np.zeros(1024, np.int64)
        self.checks = np.zeros(1024, np.uint64)
        self.pool = np.zeros(4096, np.uint32)
        self.used = 0

    def _starts(self, codes: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point of each pre-token and whether it counts (white space doesn't for "word")."""
        n = len(codes)
        fresh = np.zeros(n + 1, bool)
        fresh[begins] = True
        fresh[n] = True
        fresh = fresh[: n + 1]
        change = np.ones(n, bool)
        change[1:] = kinds[1:] != kinds[:-1]
        run = change | fresh[:n]
        space = kinds == _SPACE
        if self.kind == "byte":
            start = run.copy()
            blank_before = np.zeros(n, bool)
            blank_before[1:] = (codes[:-1] == 0x20) & ~fresh[1:n]
            start &= space | ~blank_before
            before_word = np.zeros(n, bool)
            before_word[:-1] = space[:-1] & ~space[1:] & ~fresh[1:n]
            start |= before_word
        else:
            start = run | (kinds == _DIGIT)
        quotes = np.flatnonzero((codes[:-1] == 39) & start[:-1] & (kinds[1:] == _LETTER) & ~fresh[1:n]) if n > 1 else []
        for p in quotes:
            ends = p + 4
            tail = "".join(map(chr, codes[p + 1 : min(n, ends)]))
            if self.kind == "word":
                tail = tail.lower()
            for suffix in _SUFFIXES:
                k = len(suffix)
                if tail.startswith(suffix) and not fresh[p + 1 : p + 1 + k].any():
                    start[p + 1] = False
                    if p + 1 + k < n:
                        start[p + 1 + k] = True
                    break
        at = np.flatnonzero(start)
        return at, (~space[at] if self.kind == "word" else np.ones(len(at), bool))

    def _learn(self, keys: list[int], pieces: list[str]) -> None:
        """Encode new distinct pre-tokens, many in one string, and keep their ids."""
        if self.kind == "byte":
            alone = [p.isspace() for p in pieces]
            joined = "\n".join("." if x else p for p, x in zip(pieces, alone, strict=True))
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            breaks = np.flatnonzero(ids == self.line_break)
            begins, ends = np.concatenate([[0], breaks + 1]), np.append(breaks, len(ids))
        else:
            alone = []
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            begins = np.concatenate([[0], ends[:-1]])
        if len(begins) != len(pieces):  # a piece that the library cuts again: take each on its own
            own = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        else:
            own = None
            for i in (i for i, x in enumerate(alone) if x):
                more = np.array(self.tokenizer.encode(pieces[i], add_special_tokens=False).ids, np.uint32)
                begins[i], ends[i] = len(ids), len(ids) + len(more)
                ids = np.concatenate([ids, more])
        if own is not None:
            ends = np.cumsum([len(x) for x in own])
            begins = np.concatenate([[0], ends[:-1]])
            ids = np.array([i for x in own for i in x], np.uint32)
        n, at = len(self.known), self.used
        while n + len(keys) > len(self.lengths):
            self.lengths, self.begins = np.resize(self.lengths, 2 * len(self.lengths)), np.resize(self.begins, 2 * len(self.begins))
        while at + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[at : at + len(ids)] = ids
        self.lengths[n : n + len(keys)], self.begins[n : n + len(keys)] = ends - begins, begins + at
        self.used += len(ids)
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat uint32 ids, ids of each document) of the documents in ``data``."""
        import pandas as pd

        n_docs = len(offsets) - 1
        text = data.tobytes().decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        borders = lead[offsets]
        kinds = np.full(len(codes), _RARE, np.uint8)
        low = codes < len(_CLASS)
        kinds[low] = _CLASS[codes[low]]
        rare = np.flatnonzero(kinds == _RARE)
        slow = np.unique(np.searchsorted(borders, rare, "right") - 1) if len(rare) else np.zeros(0, np.int64)
        if "<|" in text:  # the library looks for special tokens in whole texts
            marks = [i for i in range(n_docs) if "<|" in text[borders[i] : borders[i + 1]]]
            slow = np.unique(np.concatenate([slow, np.array(marks, np.int64)]))
        counts = np.zeros(n_docs, np.int64)
        flat = np.zeros(0, np.uint32)
        if len(codes):
            starts, counted = self._starts(codes, kinds, borders[:-1][borders[:-1] < len(codes)])
            ends = np.append(starts[1:], len(codes))
            if len(slow):
                is_slow = np.zeros(n_docs, bool)
                is_slow[slow] = True
                counted &= ~is_slow[np.searchsorted(borders, starts, "right") - 1]
            starts, ends = starts[counted], ends[counted]
            owner = np.searchsorted(borders, starts, "right") - 1
            keys, checks = (span_hashes(codes.view(np.uint8), 4 * starts, 4 * ends, seed=k) for k in (0, 1))
            which, distinct = pd.factorize(keys)
            if len(self.known) + len(distinct) > CACHE_WORDS:
                self.reset()
            first = np.zeros(len(distinct), np.int64)
            first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            names = distinct.tolist()
            place = np.array(list(map(self.known.get, names, repeat(-1))), np.int64)
            new = np.flatnonzero(place < 0)
            at, n = 0, len(self.known)
            for at in range(0, len(new), 500):
                part = new[at : at + 500]
                pieces = [text[a:b] for a, b in zip(starts[first[part]].tolist(), ends[first[part]].tolist(), strict=True)]
                self._learn(distinct[part].tolist(), pieces)
            place[new] = np.arange(n, n + len(new))
            while len(self.checks) < len(self.lengths):
                self.checks = np.resize(self.checks, 2 * len(self.checks))
            self.checks[place[new]] = checks[first[new]]
            where = place[which]
            unlike = np.flatnonzero(self.checks[where] != checks)
            if len(unlike):  # equal keys of different pre-tokens: their documents go through the library
                slow = np.unique(np.concatenate([slow, owner[unlike]]))
                mine = np.isin(owner, slow, invert=True)
                where, owner = where[mine], owner[mine]
            size = self.lengths[where]
            counts += np.bincount(owner, size, n_docs).astype(np.int64)
            flat = gather(self.pool, self.begins[where], size)
        if len(slow):
            own = {int(i): np.array(self.tokenizer.encode(text[borders[i] : borders[i + 1]], add_special_tokens=False).ids, np.uint32) for i in slow}
            at = np.concatenate([[0], np.cumsum(counts)])
            flat = np.concatenate([own[i] if i in own else flat[at[i] : at[i + 1]] for i in range(n_docs)])
            counts[list(own)] = [len(x) for x in own.values()]
        return flat, counts


def gather(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs pool[begin : begin + size], one after the other."""
    total = int(sizes.sum())
    if not total:
        return pool[:0]
    ends = np.cumsum(sizes)
    index = np.arange(total, dtype=np.int64) + np.repeat(begins - (ends - sizes), sizes)
    return pool[index]


def vocabulary_size(path: str) -> int:
    """Largest id of a vocabulary file + 1."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values()) + 1


def encoder(path: str, kind: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return kept(("encoder", path, kind), lambda: WordEncoder(path, kind))
