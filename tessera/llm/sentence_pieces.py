"""Operator 2: SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text gets a blank in front, blanks become the vocabulary's blank mark, and pieces never reach over the start of a
word, so words are encoded one by one. A word's agenda holds its candidate merges by score, then from left to right. The
best one is taken off and either done or, if a keyed hash of (seed, epoch, document, word number, word, pair, place) falls below the
dropout rate, skipped for good; merges done add candidates with their new neighbours. So every segmentation is one that
merges can reach, and with a rate of 0 it is the library's. Characters outside the vocabulary (and a blank mark that
stands in the text) become byte pieces: decoding gives every text back byte for byte.

Every occurrence of a word has hashes of its own. What a worker keeps for a word is its segmentation without dropout and
the candidates that were tested on the way: an occurrence that skips none of them has that segmentation, any other one is
segmented anew. Words of up to ``LONG`` characters are encoded many at a time with array operations, longer ones with a
heap.

One narrow pass, no exchange. Defined cases: a null or empty text has no pieces; rows are encoded one by one, so
repeated rows give equal pieces; a null id hashes as 0.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textspans import mix, span_hashes, text_slices
from tessera.llm.wordcache import gather

RATE, LONG = 0.1, 96
CACHE_WORDS = 500_000
_MARK, _NEVER = "▁", np.int32(2**31 - 1)


class PieceModel:
    """Merges, bytes and characters of a SentencePiece BPE vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        ids = {names[i]: i for i in plain}
        self.chars = np.full(0x110000, -1, np.int32)  # piece of a character; characters without one are self.size + code
        for i in plain:
            if len(names[i]) == 1 and names[i] != _MARK:
                self.chars[ord(names[i])] = i
        self.chars[0x20] = ids[_MARK]
        lost = self.chars < 0
        self.chars[lost] = self.size + np.flatnonzero(lost)
        scores = np.array([library.get_score(i) for i in range(self.size)])
        _, rank = np.unique(-scores, return_inverse=True)
        pairs = {}
        for i in plain:
            for k in range(1, len(names[i])):
                a, b = ids.get(names[i][:k]), ids.get(names[i][k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int32)
        self.ranks = rank.astype(np.int32)
        self.bytes = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        known = set(plain)
        content = [bytes([int(names[i][3:5], 16)]) if library.is_byte(i) else names[i].replace(_MARK, " ").encode() if i in known else b"" for i in range(self.size)]
        self.content = np.frombuffer(b"".join(content), np.uint8)
        self.content_sizes = np.array([len(c) for c in content], np.int64)
        self.content_begins = np.cumsum(self.content_sizes) - self.content_sizes

    def candidates(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of symbol pairs; rank _NEVER where they don't merge."""
        ok = (a >= 0) & (b >= 0) & (a < self.size) & (b < self.size)
        key = np.where(ok, a.astype(np.int64) * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        piece = self.merged[at]
        return np.where(hit, self.ranks[piece], _NEVER), piece

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The pieces' bytes, the blank in front included."""
        return gather(self.content, self.content_begins[ids], self.content_sizes[ids])


def tested(pairs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The part of a candidate's hash that its word's occurrences share."""
    return mix(pairs.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + places.astype(np.uint64))


def skipped(keys: np.ndarray, tests: np.ndarray, rate: float) -> np.ndarray:
    """Whether the keyed hash drops each candidate."""
    if rate <= 0:
        return np.zeros(len(keys), bool)
    return (mix(keys ^ tests) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


def segment_together(model: PieceModel, symbols: np.ndarray, keys: np.ndarray, rate: float, seen: list | None = None) -> np.ndarray:
    """Agenda processing of many words at once. symbols: words x places, -1 after a word's end; returns what is left.

    ``seen`` gets (words, tests) of the candidates taken off.
    """
    n, width = symbols.shape
    sym = symbols.copy()
    if width < 2:
        return sym
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
    before = after - 2
    rank = np.full((n, width), _NEVER, np.int32)
    piece = np.zeros((n, width), np.int32)
    r, p = model.candidates(sym[:, :-1].ravel(), sym[:, 1:].ravel())
    rank[:, :-1], piece[:, :-1] = r.reshape(n, width - 1), p.reshape(n, width - 1)
    rows = np.arange(n)
    while len(rows):
        at = np.argmin(rank[rows], axis=1)
        live = rank[rows, at] != _NEVER
        rows, at = rows[live], at[live]
        if not len(rows):
            break
        right = after[rows, at]
        pairs = sym[rows, at].astype(np.int64) * model.size + sym[rows, right]
        tests = tested(pairs, at)
        if seen is not None:
            seen.append((rows, tests))
        drop = skipped(keys[rows], tests, rate)
        rank[rows[drop], at[drop]] = _NEVER
        i, j, k = rows[~drop], at[~drop], right[~drop]
        sym[i, j] = piece[i, j]
        sym[i, k] = -1
        rank[i, k] = _NEVER
        far = after[i, k]
        after[i, j] = far
        has = (far < width) & (sym[i, np.minimum(far, width - 1)] != -1)
        before[i[has], far[has]] = j[has]
        r, p = model.candidates(sym[i, j], np.where(has, sym[i, np.minimum(far, width - 1)], -1))
        rank[i, j], piece[i, j] = r, p
        left = before[i, j]
        has = left >= 0
        i, j, left = i[has], j[has], left[has]
        r, p = model.candidates(sym[i, left], sym[i, j])
        rank[i, left], piece[i, left] = r, p
    return sym


def segment_alone(model: PieceModel, symbols: np.ndarray, key: int, rate: float, seen: list | None = None) -> np.ndarray:
    """The same for one long word, with a heap as the agenda."""
    n = len(symbols)
    sym = symbols.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    r, p = model.candidates(symbols[:-1], symbols[1:])
    table = {}
    agenda = []

    def propose(at: int, rank: int, piece: int) -> None:
        table[at] = (rank, piece, after[at])
        if rank != _NEVER:
            heapq.heappush(agenda, (rank, at))

    for at in np.flatnonzero(r != _NEVER).tolist():
        propose(at, int(r[at]), int(p[at]))

    def look(a: int, b: int) -> None:
        rank, piece = model.candidates(np.array([sym[a]]), np.array([sym[b]]))
        propose(a, int(rank[0]), int(piece[0]))

    keys = np.array([key], np.uint64)
    while agenda:
        rank, at = heapq.heappop(agenda)
        now = table.get(at)
        if now is None or now[0] != rank or sym[at] == -1:
            continue
        del table[at]
        right = after[at]
        tests = tested(np.array([sym[at] * model.size + sym[right]]), np.array([at]))
        if seen is not None:
            seen.append((np.zeros(1, np.int64), tests))
        if skipped(keys, tests, rate)[0]:
            continue
        sym[at], sym[right] = now[1], -1
        table.pop(right, None)
        after[at] = after[right]
        if after[at] < n:
            before[after[at]] = at
            look(at, after[at])
        if before[at] >= 0:
            look(before[at], at)
    return np.array(sym, np.int32)


class Pool:
    """Growing arrays of numbered lists."""

    def __init__(self, dtype: type):
        self.begins, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used, self.n = np.zeros(4096, dtype), 0, 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.n + len(sizes) > len(self.sizes):
            self.begins, self.sizes = np.resize(self.begins, 2 * len(self.begins)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.begins[self.n : self.n + len(sizes)], self.sizes[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def get(self, which: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.begins[which], self.sizes[which])


class PieceEncoder:
    """Encodes slices of documents; keeps each word's segmentation without dropout and the candidates tested for it."""

    def __init__(self, path: str, rate: float, seed: int, epoch: int):
        self.model, self.rate = PieceModel(path), rate
        self.seed = mix(mix(np.array([seed], np.int64).view(np.uint64)) ^ np.array([epoch], np.int64).view(np.uint64))[0]
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.tests, self.checks = Pool(np.uint32), Pool(np.uint64), Pool(np.uint64)

    def _ids(self, left: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of characters without a piece; (flat ids, ids of each word)."""
        lost = left >= self.model.size
        if lost.any():
            parts = [[int(s)] if s < self.model.size else self.model.bytes[list(chr(s - self.model.size).encode())].tolist() for s in left.tolist()]
            owner = np.repeat(owner, [len(x) for x in parts])
            left = np.array([i for x in parts for i in x])
        return left.astype(np.uint32), np.bincount(owner, minlength=n).astype(np.int64)

    def _segment(self, keys: np.ndarray, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, rate: float, record: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
        """(words, flat ids, ids of each word, candidates tested) of groups of words of nearly the same length."""
        order = np.argsort(sizes, kind="stable")
        ordered = sizes[order]
        a = 0
        while a < len(order):
            width = int(ordered[a])
            if width > LONG:
                break
            top = width + max(1, width // 4)
            b = min(a + 20_000, int(np.searchsorted(ordered, min(top, LONG), "right")))
            rows = order[a:b]
            most = int(sizes[rows[-1]])
            place = np.arange(most)
            inside = place[None, :] < sizes[rows][:, None]
            matrix = np.where(inside, symbols[np.minimum(begins[rows][:, None] + place, len(symbols) - 1)], -1)
            seen: list = []
            left = segment_together(self.model, matrix, keys[rows], rate, seen if record else None)
            own, at = np.nonzero(left != -1)
            yield rows, *self._ids(left[own, at], own, len(rows)), seen
            a = b
        for i in order[a:].tolist():
            seen = []
            left = segment_alone(self.model, symbols[begins[i] : begins[i] + sizes[i]], int(keys[i]), rate, seen if record else None)
            left = left[left != -1]
            yield np.array([i]), *self._ids(left, np.zeros(len(left), np.int64), 1), seen

    def _learn(self, keys: np.ndarray, checks: np.ndarray, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        for rows, flat, counts, seen in self._segment(keys, symbols, begins, sizes, 0.0, self.rate > 0):
            self.known.update(zip(keys[rows].tolist(), range(self.ids.n, self.ids.n + len(rows)), strict=True))
            self.ids.add(flat, counts)
            self.checks.add(checks[rows], np.ones(len(rows), np.int64))
            own = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in seen)])
            tests = np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in seen)])
            self.tests.add(tests[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(rows)))

    def _varied(self, place: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The occurrences (words ``place``, own ``keys``) that skip a candidate."""
        found = []
        for a in range(0, len(place), 200_000):
            n = self.tests.sizes[place[a : a + 200_000]]
            owner = np.repeat(np.arange(a, a + len(n)), n)
            found.append(np.unique(owner[skipped(keys[owner], self.tests.get(place[a : a + 200_000]), self.rate)]))
        return np.concatenate(found)

    def encode(self, data: np.ndarray, offsets: np.ndarray, doc_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat uint32 ids, ids of each document)."""
        import pandas as pd

        n_docs = len(offsets) - 1
        text = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        borders = lead[offsets]
        full = np.flatnonzero(np.diff(borders))  # documents with text; each gets a blank in front
        if not len(full):
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        lengths = np.diff(borders)[full]
        codes = np.full(len(text) + len(full), 0x20, np.uint32)
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        inside = np.ones(len(codes), bool)
        inside[starts] = False
        codes[inside] = text
        blank = codes == 0x20
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[starts] = True
        begins = np.flatnonzero(first)
        sizes = np.diff(np.append(begins, len(codes)))
        owner = np.searchsorted(starts, begins, "right") - 1
        keys, checks = (span_hashes(codes.view(np.uint8), 4 * begins, 4 * (begins + sizes), seed=k) for k in (0, 1))
        number = np.arange(len(begins)) - np.searchsorted(owner, owner)
        symbols = self.model.chars[codes]
        names = keys
        while True:
            which, distinct = pd.factorize(names)
            if len(self.known) + len(distinct) > CACHE_WORDS:
                self.reset()
            sample = np.zeros(len(distinct), np.int64)
            sample[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            new = np.flatnonzero(np.fromiter((k not in self.known for k in distinct.tolist()), bool, len(distinct)))
            if len(new):
                self._learn(distinct[new], checks[sample[new]], symbols, begins[sample[new]], sizes[sample[new]])
            place = np.fromiter(map(self.known.__getitem__, distinct.tolist()), np.int64, len(distinct))[which]
            unlike = self.checks.flat[place] != checks
            if not unlike.any():
                break
            names = np.where(unlike, mix(names ^ checks), names)  # equal names of different words
        n_ids = self.ids.sizes[place]
        counts = np.zeros(n_docs, np.int64)
        varied = np.zeros(0, np.int64)
        if self.rate > 0:
            own = mix(keys ^ mix(mix(doc_keys[full][owner] ^ self.seed) + number.astype(np.uint64)))
            varied = self._varied(place, own)
        if not len(varied):
            counts[full] = np.bincount(owner, n_ids, len(full)).astype(np.int64)
            return self.ids.get(place), counts
        fresh = Pool(np.uint32)
        at = np.zeros(len(varied), np.int64)
        for rows, flat, sizes_of, _ in self._segment(own[varied], symbols, begins[varied], sizes[varied], self.rate, False):
            at[rows] = np.arange(fresh.n, fresh.n + len(rows))
            fresh.add(flat, sizes_of)
        n_ids[varied] = fresh.sizes[at]
        counts[full] = np.bincount(owner, n_ids, len(full)).astype(np.int64)
        changed = np.zeros(len(place), bool)
        changed[varied] = True
        mine = np.repeat(changed, n_ids)
        out = np.empty(len(mine), np.uint32)
        out[mine], out[~mine] = fresh.get(at), self.ids.get(place[~changed])
        return out, counts


_ENCODERS: dict[tuple, PieceEncoder] = {}


def piece_encoder(path: str, rate: float, seed: int, epoch: int) -> PieceEncoder:
    key = (path, rate, seed, epoch)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(path, rate, seed, epoch)
    return _ENCODERS[key]


def _doc_keys(column: pa.Array) -> np.ndarray:
    return mix(column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))


def encode_pieces(docs: DataFrame, vocabulary: str, rate: float = RATE, seed: int = 0, epoch: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pieces): the piece ids of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("pieces", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary, rate, seed, epoch)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a)
                flat, counts = encoder.encode(data, offsets, _doc_keys(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), lists], schema=schema)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, pieces array<int>")


def decode_pieces(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of (doc_id, pieces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_encoder(vocabulary, 0.0, 0, 0).model
        for batch in batches:
            pieces = batch.column(1)
            texts = [None if p is None else model.decode(np.array(p, np.int64)).tobytes()[1:].decode("utf-8", "replace") for p in pieces.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, rate: float = RATE, seed: int = 0, epoch: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids) and lossless (decoding gives the text back)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary, rate, seed, epoch)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a)
                flat, counts = encoder.encode(data, offsets, _doc_keys(ids))
                ends = np.cumsum(counts)
                crc = [zlib.crc32(flat[e - n : e].astype("<u4")) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                model = encoder.model
                back = model.decode(flat)
                sums = np.concatenate([[0], np.cumsum(model.content_sizes[flat])])
                to, frm = sums[ends], sums[ends - counts]
                same = [(n == 0 and p == q) or (n > 0 and np.array_equal(back[s + 1 : t], data[p:q])) for s, t, n, p, q in zip(frm.tolist(), to.tolist(), counts.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(counts), pa.array(crc, pa.int64()), pa.array(same)], schema=schema)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
