"""Byte n-gram language models with modified Kneser-Ney smoothing, counted by Spark over every document.

A key packs a 23-bit number of the language (its place among the names in order) and up to five bytes (A-Z in lower case, white space as a blank, digits as
0), so a model of all languages is one set of ascending key arrays. Order 5 has the occurrences, lower orders the
numbers of distinct left neighbours. Each n-gram also gets its leave-one-out probability, as if one occurrence (and,
where that was the last one, its lower-order types) weren't there: documents are scored by a model that they are part
of, and without that a text of strings seen nowhere else would look likely.

The model stays in the shared folder as Parquet; a scoring worker loads it once into sorted arrays if it has at most
``MAX_RESIDENT`` rows, 16 bytes each and about twice that while the largest order is sorted. Beyond that the documents' distinct n-grams are joined with it instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import materialize, open_fs
from tessera.llm.textspans import text_slices
from tessera.llm.worker import drop_kept, give_back, kept

ORDER = 5
MAX_RESIDENT = 8_000_000
SLICE = 1 << 19  # bytes of text whose keys are held at once
HELD, HELD_MERGED = 1_000_000, 700_000  # n-grams that a counting task holds, before and after equal ones are added up
_FORM = np.arange(256, dtype=np.uint8)
_FORM[65:91] += 32
_FORM[48:58] = 48
_FORM[[9, 10, 11, 12, 13]] = 32
_START = 10  # fills the context of a document's first bytes


def language_codes(docs: DataFrame, lang_col: str) -> dict[str, int]:
    """A number from 1 for each language name; null and names that aren't in the table have 0."""
    names = sorted(r[0] for r in docs.select(F.col(lang_col).cast("string")).where(F.col(lang_col).isNotNull()).distinct().collect())
    if len(names) >= 1 << 23:
        raise ValueError(f"{lang_col} has {len(names)} values, too many for languages")
    return {name: k + 1 for k, name in enumerate(names)}


def document_keys(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """One order-5 key for each byte; ``codes`` has each document's language code."""
    sizes = np.diff(offsets)
    padded = np.full(len(data) + (ORDER - 1) * len(sizes), _START, np.uint8)
    place = np.arange(len(data), dtype=np.int64) + np.repeat((ORDER - 1) * np.arange(1, len(sizes) + 1), sizes)
    padded[place] = _FORM[data]
    keys = np.repeat(codes.astype(np.int64) << 40, sizes)
    for k in range(ORDER):
        keys |= padded[place - k].astype(np.int64) << (8 * k)
    return keys


def _batch_keys(batch: pa.RecordBatch, text: int, lang: int, codes: dict[str, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    languages = batch.column(lang).dictionary_encode()
    table = np.array([codes.get(x, 0) for x in languages.dictionary.to_pylist()] + [0], np.int64)
    which = languages.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)
    for a, b, data, offsets in text_slices(batch.column(text), SLICE):
        yield a, b, offsets, document_keys(data, offsets, table[which[a:b]])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _count(codes: dict[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pandas as pd

    drop_kept()
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def flushed(table: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(table[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(table[0][a : a + 100_000]), pa.array(table[1][a : a + 100_000])], names=["key", "n"])

    for batch in batches:
        for *_, keys in _batch_keys(batch, 0, 1, codes):
            if len(keys):
                which, distinct = pd.factorize(keys)
                parts.append((distinct, np.bincount(which, minlength=len(distinct))))
                held += len(distinct)
            if held > HELD:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > HELD_MERGED:  # bounded memory: what is left is added up by Spark
                    yield from flushed(parts[0])
                    parts, held = [], 0
    if parts:
        yield from flushed(_merged(parts))
    parts = []
    give_back()


def _discount(a: Column, d: dict[int, Column]) -> Column:
    return F.when(a <= 0, F.lit(0.0)).when(a == 1, d[1]).when(a == 2, d[2]).otherwise(d[3])


def _shift(key: Column) -> Column:
    """The n-gram without its last byte, as a context of the order below."""
    return F.shiftleft(F.shiftright(key, 40), 40).bitwiseOR(F.shiftright(key.bitwiseAND(F.lit((1 << 40) - 1)), 8))


def _suffix(key: Column, order: int) -> Column:
    """The n-gram without its first byte."""
    return F.shiftleft(F.shiftright(key, 40), 40).bitwiseOR(key.bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1)))


def kneser_ney(docs: DataFrame, codes: dict[str, int], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The model: (order, key, p, loo, bow); bow is the weight that a context of that order gives the order below it.

    ``p`` is the interpolated probability of an n-gram's last byte, ``loo`` the same with one occurrence left out.
    """
    counted = docs.select(F.col(text_col), F.col(lang_col)).mapInArrow(partial(_count, codes), "key long, n long")
    table = materialize(counted.groupBy("key").agg(F.sum("n").alias("a")), "ngrams")
    orders = {ORDER: table}
    for k in range(ORDER, 1, -1):
        orders[k - 1] = orders[k].groupBy(_suffix(F.col("key"), k).alias("key")).agg(F.count("*").alias("a"))
    lower: DataFrame | None = None
    out: DataFrame | None = None
    for k in range(1, ORDER + 1):
        rows = orders[k].select("key", "a", F.shiftright("key", 40).alias("lang"), _shift(F.col("key")).alias("ctx"))
        n = {i: F.sum(F.when(F.col("a") == i, 1).otherwise(0)).cast("double") for i in range(1, 5)}
        per_lang = rows.groupBy("lang").agg(*(n[i].alias(f"n{i}") for i in n))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

        def amount(i: int, fallback: float, y: Column = y) -> Column:
            least = F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))
            return F.greatest(F.lit(0.1 * i), F.least(F.coalesce(least, F.lit(fallback)), F.lit(float(i) - 0.05))).alias(f"d{i}")

        per_lang = per_lang.select("lang", amount(1, 0.5), amount(2, 1.0), amount(3, 1.5))
        ctx = rows.groupBy("lang", "ctx").agg(F.sum("a").alias("total"), F.count_if(F.col("a") == 1).alias("c1"), F.count_if(F.col("a") == 2).alias("c2"), F.count_if(F.col("a") > 2).alias("c3"))
        ctx = ctx.join(per_lang, "lang").withColumn("mass", F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3"))
        r = rows.drop("lang").join(ctx.drop("lang"), "ctx")
        if lower is None:
            r = r.withColumn("p0", F.lit(1 / 256)).withColumn("q0", F.lit(1 / 256))
        else:
            r = r.withColumn("low", _suffix(F.col("key"), k)).join(lower.select(F.col("key").alias("low"), F.col("p").alias("p0"), F.col("loo").alias("q0")), "low")
        d = {i: F.col(f"d{i}") for i in (1, 2, 3)}
        a, total, mass = F.col("a"), F.col("total"), F.col("mass")
        p = F.greatest(a - _discount(a, d), F.lit(0.0)) / total + mass / total * F.col("p0")
        left = F.when(a > 1, (a - 1 - _discount(a - 1, d)) / (total - 1) + F.least(F.lit(1.0), mass / (total - 1)) * F.col("p0")).when(total > 1, F.least(F.lit(1.0), (mass - F.col("d1")) / (total - 1)) * F.col("q0")).otherwise(F.col("q0"))
        lower = materialize(r.select("key", p.alias("p"), F.greatest(left, F.lit(1e-9)).alias("loo"), "ctx", (mass / total).alias("bow")), f"order{k}")
        grams = lower.select(F.lit(k).alias("order"), "key", "p", "loo", F.lit(None).cast("double").alias("bow"))
        weights = lower.select(F.lit(-k).alias("order"), F.col("ctx").alias("key"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("loo"), "bow").distinct()
        out = grams.unionByName(weights) if out is None else out.unionByName(grams).unionByName(weights)
    return out


class ResidentModel:
    """Sorted key arrays of a stored model, with natural logarithms."""

    def __init__(self, path: str):
        files, place = open_fs(path)
        stored = ds.dataset(place, filesystem=files, format="parquet")
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.weights: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, ORDER + 1):  # one order at a time, so that little more than the arrays is in memory
            self.grams[k] = self._sorted(stored, k, "p", "loo")
            self.weights[k] = self._sorted(stored, -k, "bow", least=1e-9)

    @staticmethod
    def _sorted(stored: ds.Dataset, order: int, *values: str, least: float = 0.0) -> tuple[np.ndarray, ...]:
        """Ascending keys of an order and the logarithms of their values; the table is read one batch after the other."""
        parts = [[np.zeros(0, np.int64)], *([np.zeros(0, np.float32)] for _ in values)]
        for batch in stored.to_batches(columns=["key", *values], filter=ds.field("order") == order, batch_size=1 << 16, batch_readahead=1, fragment_readahead=1, use_threads=False):
            parts[0].append(batch["key"].to_numpy().copy())
            for part, c in zip(parts[1:], values, strict=True):
                part.append(np.log(np.maximum(batch[c].to_numpy(), least)).astype(np.float32))
        place = np.argsort(keys := np.concatenate(parts[0]))
        parts[0] = []
        keys = keys[place]
        out = []
        for part in parts[1:]:
            out.append(np.concatenate(part)[place])
            part.clear()
        return (keys, *out)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
        return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)

    def logs(self, keys: np.ndarray, member: bool) -> np.ndarray:
        """ln P of the last byte of each order-5 key; ``member``: of documents that were counted."""
        out = np.zeros(len(keys), np.float32)
        open_ = np.arange(len(keys))
        languages, grams = keys >> 40 << 40, keys & ((1 << 40) - 1)
        for k in range(ORDER, 0, -1):
            now = languages[open_] | (grams[open_] & ((1 << (8 * k)) - 1))
            table, plain, left_out = self.grams[k]
            at, hit = self._find(table, now)
            if hit.any():
                out[open_[hit]] += (left_out if member and k == ORDER else plain)[at[hit]]
            open_, now = open_[~hit], now[~hit]
            if not len(open_):
                break
            table, weight = self.weights[k]
            at, hit = self._find(table, now >> 40 << 40 | (now & ((1 << 40) - 1)) >> 8)
            if hit.any():
                out[open_[hit]] += weight[at[hit]]
        out[open_] += np.float32(np.log(1 / 256))
        return out


def resident(path: str) -> ResidentModel:
    return kept(("model", path), lambda: ResidentModel(path))
