"""Operator 9: shards of bounded size by extendible hashing.

Rows are hashed to ``HASH_BITS`` bits. The directory is a binary trie over hash prefixes: the root is one bucket, and a
bucket over the byte limit splits on its next bit, again and again; other buckets stay as they are. A bucket's prefix is
its shard. Splitting stops where a bucket has one hash value (one row, or equal rows); such a shard may exceed the limit
and says so in ``fits``.

Plan: a narrow table (id, hash, bytes) is written once. Rounds of ``ROUND_BITS`` bits sum its bytes by prefix (partial
sums, at most 2**ROUND_BITS rows for each open bucket), roll them up to every shorter prefix and close the buckets that
fit; only rows of open buckets take part in the next round, so the number of rounds follows the depth of the fullest
bucket. Rows find their shard by a join on the prefix of the round that closed it.

Defined cases: null texts have no bytes; null ids and null texts hash as a value of their own; rows equal in id and text
go to one shard; an empty table has no shards; a document larger than the limit is a shard of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import materialize

HASH_BITS, ROUND_BITS = 60, 12
SHARD_BYTES = 64 << 20


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of an MD5 of id and text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(text, F.lit("-"))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int, round_bits: int = ROUND_BITS) -> list[DataFrame]:
    """For each round, (prefix, depth, bytes, docs): the closed buckets by the prefixes of that round's bits they cover.

    ``rows`` has ``hash`` and ``n_bytes``.
    """
    out: list[DataFrame] = []
    open_rows, at = rows.select("hash", "n_bytes"), 0
    while at < HASH_BITS:
        to = min(HASH_BITS, at + round_bits)
        leaf = F.shiftright("hash", HASH_BITS - to)
        sums = open_rows.groupBy(leaf.alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        sums = materialize(sums, f"round{to}")
        depths = range(at if at == 0 else at + 1, to + 1)
        rolled = None
        for d in depths:
            one = sums.groupBy(F.shiftright("prefix", to - d).alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("low").alias("low"), F.max("high").alias("high")).select(F.lit(d).alias("depth"), "bucket", "bytes", "docs", "low", "high")
            rolled = one if rolled is None else rolled.unionByName(one)
        fits = rolled.where((F.col("bytes") <= limit) | (F.col("low") == F.col("high"))).select("depth", "bucket", "bytes", "docs")
        paths = sums.select("prefix", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.shiftright("prefix", to - d).alias("bucket")) for d in depths))).alias("p")).select("prefix", "p.depth", "p.bucket")
        closed = paths.join(fits, ["depth", "bucket"]).groupBy("prefix").agg(F.min_by(F.struct("depth", "bucket", "bytes", "docs"), "depth").alias("s")).select("prefix", "s.*")
        closed = materialize(closed, f"closed{to}")
        out.append(closed)
        rest = sums.select("prefix").join(closed.select("prefix"), "prefix", "left_anti")
        if rest.isEmpty():
            break
        open_rows = materialize(open_rows.join(rest, leaf == rest.prefix, "left_semi"), f"open{to}")
        at = to
    return out


def _assigned(docs: DataFrame, limit: int, id_col: str, text_col: str, round_bits: int) -> DataFrame:
    """doc_id, hash, n_bytes and the closed bucket of every row."""
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), row_hash(F.col(id_col), F.col(text_col)).alias("hash"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")), "hashed")
    rest, out = rows, None
    for k, closed in enumerate(directory(rows, limit, round_bits)):
        to = min(HASH_BITS, (k + 1) * round_bits)
        keyed = rest.withColumn("prefix", F.shiftright("hash", HASH_BITS - to))
        found = keyed.join(closed, "prefix")
        out = found if out is None else out.unionByName(found)
        rest = keyed.join(closed.select("prefix"), "prefix", "left_anti").drop("prefix")
    bits = F.when(F.col("depth") > 0, F.lpad(F.conv(F.col("bucket").cast("string"), 10, 2), F.col("depth"), F.lit("0"))).otherwise("")
    return out.withColumn("shard", bits)


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", round_bits: int = ROUND_BITS) -> DataFrame:
    """doc_id, n_bytes, shard (prefix bits as text; "" for the root), depth, shard_bytes, shard_docs and fits, for every row."""
    out = _assigned(docs, limit, id_col, text_col, round_bits)
    return out.select("doc_id", "n_bytes", "shard", F.col("depth").cast("long").alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"), (F.col("bytes") <= limit).alias("fits"))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the documents as Parquet, a folder for each shard; rows equal in id and text are in the shard of their hash.

    All columns are written; the folders' column, returned, is ``shard`` with underscores added where docs has that name.
    """
    name, own = "shard", "row_hash"
    while name in docs.columns:
        name += "_"
    while own in docs.columns:
        own += "_"
    places = _assigned(docs, limit, id_col, text_col, ROUND_BITS).select(F.col("hash").alias(own), F.concat(F.lit("p"), "shard").alias(name)).distinct()
    rows = docs.withColumn(own, row_hash(F.col(id_col), F.col(text_col))).join(places, own).drop(own)
    rows.repartition(name).write.partitionBy(name).parquet(path)
    return name
