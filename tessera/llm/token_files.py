"""Operator 1: flat token-id files with 64-bit document offsets.

Layout of a folder: for each part, ``<part>.ids`` (all ids as little-endian unsigned integers of 16 bits where the
vocabulary and the end id fit, else of 32, documents end to end, in ascending document id), ``<part>.offsets``
(documents + 1 unsigned 64-bit token offsets within the part) and ``<part>.docs`` (document ids as signed 64-bit
integers, null ids first as zeros). Parts are ranges of document ids, so the whole collection is the parts one after the
other; a manifest gives each part's first token and document, found by prefix sums over the parts' sizes, and how many
ids are null. Every file can be memory-mapped.

Plan: one range exchange of the texts, one encoding pass, then only the manifest (a row for each part) is summed up.
The number of parts grows with the input. A part's files carry the name of the attempt that wrote them; the manifest,
committed by Spark, names the attempts that count, so a task that runs twice, at once or after an executor is lost, does
no harm and nothing is renamed. Files of other attempts are deleted at the end.

Defined cases: a null text is an empty one (only the end id); a null document id comes first and reads back as null;
rows that share an id keep a row each, in the order of their texts; an empty table gives an empty manifest; other
columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import materialize, open_fs, planned_bytes
from tessera.llm.textspans import text_slices
from tessera.llm.wordcache import encoder, gather, vocabulary_size

PART_BYTES = 256 << 20  # of input as Spark estimates it


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the files; returns the manifest (part, path, width, n_docs, n_null, n_tokens, first_doc, first_token)."""
    spark = docs.sparkSession
    width = "<u2" if max(vocabulary_size(vocabulary), end_id + 1) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-planned_bytes(rows) // PART_BYTES))
    # The start of the text lets even one id fill several ranges.
    ordered = rows.repartitionByRange(n, "doc_id", F.left("text", F.lit(64))).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, root = open_fs(folder)
        own = f"{part:06d}-{uuid.uuid4().hex}"
        name = f"{root}/{own}"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        files.create_dir(root, recursive=True)
        encode = encoder(vocabulary, kind)
        total = docs_seen = nulls = 0
        with files.open_output_stream(f"{name}.ids") as ids_out, files.open_output_stream(f"{name}.offsets") as offsets_out, files.open_output_stream(f"{name}.docs") as docs_out:
            offsets_out.write(np.zeros(1, "<u8").tobytes())

            def all_batches() -> Iterator[pa.RecordBatch]:
                yield first
                yield from batches

            for batch in all_batches():
                docs_out.write(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                nulls += batch.column(0).null_count
                docs_seen += batch.num_rows
                for _, _, data, offsets in text_slices(batch.column(1)):
                    flat, counts = encode.encode(data, offsets)
                    ends = np.cumsum(counts + 1)
                    out = np.full(int(ends[-1]), end_id, width)
                    inside = np.ones(len(out), bool)
                    inside[ends - 1] = False
                    out[inside] = flat
                    ids_out.write(out.tobytes())
                    offsets_out.write((ends + total).astype("<u8").tobytes())
                    total += int(ends[-1])
        row = {"part": [part], "path": [f"{folder}/{own}"], "width": [width], "n_docs": [docs_seen], "n_null": [nulls], "n_tokens": [total]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("path", pa.string()), ("width", pa.string()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64())]))

    written = materialize(ordered.mapInArrow(write, "part int, path string, width string, n_docs long, n_null long, n_tokens long"), "token-parts")
    _delete_others(folder, {row.path.rsplit("/", 1)[1] for row in written.select("path").toLocalIterator()})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    return written.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(name) for c, name in (("n_docs", "first_doc"), ("n_tokens", "first_token"))))


def _delete_others(folder: str, kept: set[str]) -> None:
    """Files of attempts that the manifest doesn't name."""
    files, root = open_fs(folder)
    for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.rsplit(".", 1)[0] not in kept:
            files.delete_file(info.path)


def _mapped(path: str) -> np.ndarray:
    files, place = open_fs(path)
    with files.open_input_file(place) as f:
        size = f.size()
        if not size:
            return np.zeros(0, np.uint8)
        if files.type_name == "local":
            return np.memmap(place, np.uint8, "r")
        return np.frombuffer(f.read_buffer(size), np.uint8)


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids themselves."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        kinds.append(("ids", pa.list_(pa.int64())))
    schema = pa.schema(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _mapped(row["path"] + ".ids").view(row["width"])
                offsets = _mapped(row["path"] + ".offsets").view("<u8").astype(np.int64)
                doc_ids = _mapped(row["path"] + ".docs").view("<i8")
                if len(offsets) != row["n_docs"] + 1 or offsets[-1] != row["n_tokens"] or len(ids) != row["n_tokens"]:
                    raise ValueError(f"{row['path']} is not what the manifest says")
                for a in range(0, len(doc_ids), 4096):
                    some = doc_ids[a : a + 4096]
                    at = offsets[a : a + len(some) + 1]
                    columns = [
                        pa.array(some, pa.int64(), mask=np.arange(a, a + len(some)) < row["n_null"]),
                        pa.array(at[:-1] + row["first_token"]),
                        pa.array(np.diff(at)),
                        pa.array([zlib.crc32(ids[s:e].astype("<u4")) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(gather(ids, at[:1], at[-1:] - at[:1]).astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return manifest.select("path", "width", "n_docs", "n_null", "n_tokens", "first_token").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
