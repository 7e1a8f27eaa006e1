"""Operator 8: exact removal of lines that many documents share, in DataFrame functions only.

A line's key is the line without ``[ \\t\\n\\v\\f\\r]`` at both ends and with A-Z in lower case. Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines but those of the largest
document id.

Method: the long lines' 128-bit key hashes are written down once and dealt out by ranges of (hash, document), sorted
within the ranges; each range streams through once and hands on, for each hash, its first occurrence in each document, of
which only counts and the largest document survive. A hash that is common enough to fill several ranges is put together
from those partial counts, so no task has to hold a common line's rows. The hashes over the threshold then mark their
lines: those of more than ``1 / HOT`` of all lines, at most ``HOT`` by count, by a broadcast, the others by a join in
which no key has more rows than that. What is dropped comes back as one bitmap for each document, run-length coded; texts
don't take part in any of this.

Defined cases: a null or empty text is one empty line; a null document id counts as one document below all others (the
id -2**63 counts with it); rows that share an id count as one document and each gets the bitmap of its own text; ties
don't arise, since the largest id keeps all its copies of a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import materialize

HOT = 10_000  # at most so many hashes have more than 1 / HOT of all lines
#: The white space that a key is stripped of.
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAST = -(2**63)  # stands for a null document id in comparisons


def line_key(line: Column) -> Column:
    """The line stripped and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _document(id_col: str, text_col: str) -> list[Column]:
    """What tells a row's bitmap from others: its id and its text's hash."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("txt")]


def _long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, txt, pos, h1, h2) of every line whose key has at least min_chars code points."""
    lines = docs.select(*_document(id_col, text_col), F.posexplode(text_lines(F.col(text_col))).alias("pos", "line"))
    lines = lines.where(F.char_length("line") >= min_chars).select("doc", "txt", "pos", line_key(F.col("line")).alias("key"))
    # The second hash starts from another seed; xxhash64(key, 1) would be a function of the first.
    return lines.where(F.char_length("key") >= min_chars).select("doc", "txt", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, txt, pos) of every line to drop; doc is the id, or -2**63 for null, txt the text's hash."""
    lines = materialize(_long_lines(docs, id_col, text_col, min_chars), "lines")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(n, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc")
    # No further exchange: a range holds all of a document's copies of a line, in order.
    firsts = ranged.groupBy("h1", "h2", "doc").agg(F.count("*").alias("n_lines"))
    common = firsts.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.sum("n_lines").alias("n_lines"), F.max("doc").alias("last_doc"))
    common = materialize(common.where(F.col("n_docs") >= min_docs), "common")
    many = lines.count() // HOT
    hot = common.where(F.col("n_lines") > many).select("h1", "h2", F.col("last_doc").alias("hot_doc"))
    marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    rare = marked.where("hot_doc IS NULL").join(common.where(F.col("n_lines") <= many).select("h1", "h2", "last_doc"), ["h1", "h2"]).where("doc < last_doc")
    return marked.where("doc < hot_doc").select("doc", "txt", "pos").unionByName(rare.select("doc", "txt", "pos"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """For each document that loses lines: doc, txt and ``drop_runs``, its keep bitmap as runs of dropped lines.

    ``drop_runs`` is an array of (first, after) positions, ascending and apart; lines outside the runs stay.
    """
    gone = dropped_lines(docs, id_col, text_col, min_chars, min_docs).groupBy("doc", "txt").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    starts = F.filter("gone", lambda x, i: (i == 0) | (F.element_at("gone", F.when(i == 0, 1).otherwise(i)) != x - 1))
    after = F.transform(F.filter("gone", lambda x, i: (i == F.size("gone") - 1) | (F.element_at("gone", F.least(i + 2, F.size("gone"))) != x + 1)), lambda x: x + 1)
    return gone.select("doc", "txt", starts.alias("starts"), after.alias("after")).select("doc", "txt", F.arrays_zip(F.col("starts").alias("first"), F.col("after").alias("after")).alias("drop_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_dropped, kept_text) of every document; ``row`` is a struct of its columns."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *_document(id_col, text_col))
    joined = rows.join(bitmaps, ["doc", "txt"], "left")
    split = joined.withColumn("lines", F.when(F.col("drop_runs").isNotNull(), F.split("text", "\n", -1)))
    # The kept stretches lie between one run's end and the next one's start.
    begins = F.concat(F.array(F.lit(0)), F.col("drop_runs.after"))
    ends = F.concat(F.col("drop_runs.first"), F.array(F.size("lines")))
    stretches = split.withColumn("stretches", F.arrays_zip(begins.alias("a"), ends.alias("b")))
    kept = F.flatten(F.transform("stretches", lambda s: F.slice("lines", s.a + 1, s.b - s.a)))
    n_dropped = F.aggregate("drop_runs", F.lit(0).cast("long"), lambda acc, r: acc + (r.after - r.first))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return stretches.select(
        "row",
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop_runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def stored_bitmaps(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """keep_bitmaps() as a table of known size, which Spark broadcasts if it is small."""
    return materialize(keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), "bitmaps")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every row of ``docs``."""
    applied = apply_bitmaps(docs, stored_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)
    return applied.select(F.col(f"row.{id_col}").alias("doc_id"), "n_lines", "n_dropped", "kept_text")


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of ``docs`` with what stays of their texts; an ``n_chars`` column follows."""
    applied = apply_bitmaps(docs, stored_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)
    new = {text_col: F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return applied.select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))
