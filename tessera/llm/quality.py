"""Operator 5: quality rules on words and lines, and an n-gram perplexity band for each language.

Base rules (counts of words, symbols, repeated lines and repeated five-word windows) come first. The method's verdict
is a band: a language model of the corpus, each distinct text of a language counted once (see language_model), gives each document the
mean ln P of its bytes. The distance from the language's median shrinks with ``1 / sqrt(bytes)``, so the quartiles of
``distance * sqrt(bytes)`` over a language's distinct texts that pass the base rules give the spread of each side at any
length; the limits lie ``low`` and ``high`` such spreads from the median. A spread counts as ``noise`` and a limit's
distance as ``least_spread`` at least, and languages of few texts get wider limits (``FEW``). Documents outside are rejected: below is
noise, above is text that repeats itself or its neighbours far beyond what the language does.

Plan: one exchange of texts that drops copies (within each task first, so a hot group moves one row a task), a counting
pass with partial sums by worker and by Spark, a model in shared Parquet, one scoring pass over the rows as they lie that
writes a narrow table, quartiles from counts on a fixed grid (so they don't depend on how rows are dealt out, and no task
holds a language's values), and a join with one row for each language.

Defined cases: a null text has no words (base_failed, not kept); a null language is a language of its own; a language
with a single document has a band around it; rows are judged one by one, so repeated rows and ids and null ids are
kept apart; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import language_model
from tessera.llm.language_model import SLICE, _batch_keys, document_keys, kneser_ney, language_codes, resident
from tessera.llm.storage import batches_of, materialize, new_folder
from tessera.llm.textspans import owners, per_document, repeated, span_hashes, text_slices, windows, words
from tessera.llm.worker import give_back

LOW, HIGH, NOISE, LEAST_SPREAD = 5.0, 5.0, 0.5, 0.02
GRID, GRID_END = 1e-3, 200.0  # values are rounded to the grid's step; beyond its ends they count as the end
FEW = 25  # a language of this many texts gets limits twice as wide, as its quartiles say little
WINDOW = 5
BATCH = 1000  # documents of an Arrow batch
#: The symbols that the base rules count.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    n = len(offsets) - 1
    starts, ends = words(data, offsets)
    owner = owners(offsets, starts)
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
    out = {"n_words": per_document(owner, n), "word_chars": per_document(owner, n, (leads[ends] - leads[starts]).astype(np.float64))}
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    out["n_symbols"] = np.diff(symbols[offsets])

    hashes = span_hashes(data, starts, ends)
    first, keys = windows(hashes, owner, WINDOW)
    salt = owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    twice = first[repeated(keys ^ salt[first])]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = per_document(owner[covered], n)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_owner = np.concatenate([np.arange(n), owners(offsets, breaks)])[np.argsort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")]
    line_ends = np.minimum(np.append(line_starts[1:] - 1, len(data)), offsets[1:][line_owner])
    last = np.append(line_owner[1:] != line_owner[:-1], True)
    line_ends[last] = offsets[1:][line_owner[last]]
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_owner = line_starts[has_word], line_ends[has_word], line_owner[has_word]
    keys = span_hashes(data, line_starts, line_ends) ^ (line_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mine = np.flatnonzero(repeated(keys))
    again = np.ones(len(mine), bool)
    again[np.unique(keys[mine], return_index=True)[1]] = False
    out["n_dup_lines"] = per_document(line_owner[mine[again]], n)
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text_hash", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("n_bytes", pa.int64()), ("log_sum", pa.float64())])
_DDL = "doc_id long, lang string, text_hash long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", n_bytes long, log_sum double"


def _scored(path: str | None, codes: dict[str, int]):
    """Base counts and, with a resident model, the sum of ln P."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        for batch in batches:
            keys_of = _batch_keys(batch, 1, 2, codes) if path else None
            for a, b, data, offsets in text_slices(batch.column(1), SLICE):
                counts = base_counts(data, offsets)
                sums = np.zeros(b - a)
                if keys_of is not None:
                    *_, keys = next(keys_of)
                    if len(keys):
                        which, distinct = pd.factorize(keys)
                        logs = resident(path).logs(distinct, member=True).astype(np.float64)
                        totals = np.concatenate([[0.0], np.cumsum(logs[which])])
                        sums = totals[offsets[1:]] - totals[offsets[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), batch.column(2).slice(a, b - a).cast(pa.string()), batch.column(3).slice(a, b - a), *(pa.array(counts[c]) for c in _COUNTS), pa.array(np.diff(offsets)), pa.array(sums)], schema=_SCHEMA)
        give_back()

    return run


def _document_ngrams(codes: dict[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, key, n) of each document's distinct n-grams, for models too large to be resident."""
    for batch in batches:
        for a, b, offsets, keys in _batch_keys(batch, 1, 2, codes):
            rows = batch.column(0).slice(a, b - a)
            for i in range(b - a):
                distinct, n = np.unique(keys[offsets[i] : offsets[i + 1]], return_counts=True)
                if len(distinct):
                    yield pa.RecordBatch.from_arrays([pa.array([rows[i].as_py()] * len(distinct), pa.int64()), pa.array(distinct), pa.array(n.astype(np.int64))], names=["row", "key", "n"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_resident: int | None = None) -> DataFrame:
    """doc_id, lang, text_hash, base counts, n_bytes and log_sum (sum of ln P, each document's own occurrences left out) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("text_hash"))
    folder = new_folder(spark, "model")
    codes = language_codes(rows, "lang")
    with batches_of(spark, BATCH):
        kneser_ney(rows.select("text", "lang").distinct(), codes).write.parquet(folder)  # copies count once: a text's copies would make it likely
    model = spark.read.parquet(folder)
    if model.count() <= (language_model.MAX_RESIDENT if max_resident is None else max_resident):
        with batches_of(spark, BATCH):
            return materialize(rows.mapInArrow(_scored(folder, codes), _DDL), "scores")
    # Rows get a number of their own, written down so that it doesn't change between uses.
    numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    grams = numbered.select("row", "text", "lang").mapInArrow(partial(_document_ngrams, codes), "row long, key long, n long")
    sums = grams.join(model.where(F.col("order") == language_model.ORDER).select("key", "loo"), "key").groupBy("row").agg(F.sum(F.col("n") * F.ln("loo")).alias("total"))
    counts = numbered.select(F.col("row").alias("doc_id"), "text", "lang", "text_hash").mapInArrow(_scored(None, codes), _DDL).withColumnRenamed("doc_id", "row").drop("log_sum")
    joined = counts.join(numbered.select("row", "doc_id"), "row").join(sums, "row", "left")
    return materialize(joined.select("doc_id", "lang", "text_hash", *_COUNTS, "n_bytes", F.coalesce("total", F.lit(0.0)).alias("log_sum")), "scores")


def grid_quantiles(rows: DataFrame, by: str, value: Column, shares: list[float]) -> DataFrame:
    """(by, n, q): the number of rows and the quantiles of a value on the grid, the least cell that reaches each share."""
    cells = rows.select(by, F.round(F.greatest(F.lit(-GRID_END), F.least(F.lit(GRID_END), value)) / GRID).cast("long").alias("cell")).groupBy(by, "cell").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(by)  # at most 2 * GRID_END / GRID + 1 rows
    counted = cells.select(by, "cell", F.sum("n").over(whole.orderBy("cell")).alias("upto"), F.sum("n").over(whole).alias("n"))
    return counted.groupBy(by).agg(F.max("n").alias("n"), F.array(*(F.min(F.when(F.col("upto") >= s * F.col("n"), F.col("cell") * GRID)) for s in shares)).alias("q"))


def judge(docs: DataFrame, low: float = LOW, high: float = HIGH, noise: float = NOISE, least_spread: float = LEAST_SPREAD, max_resident: int | None = None, **columns: str) -> DataFrame:
    """doc_id, lang, text_hash (xxhash64 of the text), the base counts, base_failed, mean_log (mean ln P of a byte), low and high (the band) and kept."""
    scores = score_documents(docs, max_resident=max_resident, **columns)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = scores.withColumn("base_failed", failed).withColumn("mean_log", F.when(F.col("n_bytes") > 0, F.col("log_sum") / F.col("n_bytes")))
    texts = rows.where(~F.col("base_failed")).groupBy(F.col("lang").alias("of"), "text_hash").agg(F.max("mean_log").alias("mean_log"), F.max("n_bytes").alias("n_bytes"))
    middles = grid_quantiles(texts, "of", F.col("mean_log"), [0.5]).select(F.col("of").alias("lang"), F.col("q")[0].alias("mid"), F.col("n").alias("n_texts"))
    away = texts.join(middles, F.col("of").eqNullSafe(F.col("lang"))).select("of", ((F.col("mean_log") - F.col("mid")) * F.sqrt("n_bytes")).alias("z"))
    quartiles = grid_quantiles(away, "of", F.col("z"), [0.25, 0.75]).select(F.col("of").alias("around"), "q")
    quartiles = quartiles.join(middles, F.col("around").eqNullSafe(F.col("lang"))).select(F.col("around").alias("of"), "mid", "n_texts", "q")
    bands = quartiles.select("of", "mid", *((F.greatest(side, F.lit(noise)) * (1 + FEW / F.col("n_texts"))).alias(name) for name, side in (("down", -F.col("q")[0]), ("up", F.col("q")[1]))))
    out = rows.join(bands, rows.lang.eqNullSafe(bands.of), "left")
    root = F.sqrt(F.greatest("n_bytes", F.lit(1)))
    below, above = (F.col("mid") - F.greatest(low * F.col("down") / root, F.lit(least_spread)), F.col("mid") + F.greatest(high * F.col("up") / root, F.lit(least_spread)))
    kept = ~F.col("base_failed") & F.coalesce(F.col("mean_log").between(below, above), F.lit(True))
    return out.select("doc_id", "lang", "text_hash", *_COUNTS, "base_failed", "mean_log", below.alias("low"), above.alias("high"), kept.alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits: float) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with all their columns."""
    verdicts = judge(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **limits).where("kept").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text_hash").alias("_hash")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(verdicts._id) & docs[lang_col].cast("string").eqNullSafe(verdicts._lang) & (F.xxhash64(docs[text_col]) == verdicts._hash)
    return docs.join(verdicts, same, "left_semi")


__all__ = ["base_counts", "document_keys", "judge", "keep_good", "score_documents"]
