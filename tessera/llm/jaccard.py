"""Operator 6: exact Jaccard join of documents on word shingles, by signature trees.

1. One hashing pass gives each document its set of distinct shingle hashes, as a size, a 128-bit digest, a bitmap and
   blocking keys; equal sets are one vertex, named by their least id.
2. Blocking without loss: sets that may link differ in at most d shingles (d follows from their size level). Of m > d
   parts of the hash space at least m - d then hold the same shingles in both. Under any order of the parts by content,
   the last of those is among the d + 1 last parts of both documents, so a document's keys are its d + 1 strongest parts
   (those of most shingles). Empty parts and parts of a single shingle, by which unrelated texts would meet, come last
   and are left out.
3. First round: each vertex is compared with the least vertex that it shares a key with. Only links that hold exactly
   are closed to components, so chains of mere neighbours don't build up.
4. Second round: keys whose vertices are in one component need nothing more. The vertices of the others are put in
   order of (component, size) and cut into blocks, each a signature-tree node: the OR of its documents' token bitmaps,
   its range of sizes and its least number of set bits. Blocks of a key meet where the largest overlap that two nodes
   allow reaches the threshold and both aren't in one component; of blocks that meet, and within a block, the same is
   asked of single documents by their bitmaps, before any text moves.
   Documents that are left and meet under some key form bundles, so that one of many keys in common is compared once.
   A bundle is cut into blocks in the same way, and its blocks meet by the same bound.
5. A task of either round builds a signature tree over its documents and traverses it against itself: node pairs whose
   largest possible overlap is too small, or whose documents are connected already, go; what is left is compared
   exactly. Only spanning edges come out, so a group of thousands of copies yields as many edges as members.

Scale: (2) moves about 0.2 keys for a shingle (0.5 at 80 percent) once, by ranges that split even a single key; copies
within a task send theirs once. (3) moves a text once for each vertex that shares a key, (4) once for each vertex of a
bundle of one block, else once for each block that its own meets. Texts take fewer bytes in an exchange than their
64-bit shingle hashes. Nothing but tables that Spark knows to be small is broadcast, and nothing is collected.

Defined cases: A-Z count as lower case; a text with fewer words than a shingle is one shingle of its whole sequence;
without words (null, empty, blanks) a document links with nothing; a null id links with nothing and has a null
component; rows that share an id are one vertex; repeated rows are equal sets. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.storage import batches_of, discard, materialize
from tessera.llm.textspans import mix, owners, per_document, span_hashes, text_slices, windows, words

BLOCK_DOCS, BLOCK_SHINGLES = 96, 400_000
BITS, LEAF, FANOUT = 1024, 8, 4
SLICE = 1 << 20  # bytes of text hashed at once; a worker needs about 50 times as much
NAMED = 26  # of a bitmap's places, the power of two; the bitmap takes 8 MB
TASKS = 64  # tasks in an Arrow batch, as one may hold BLOCK_SHINGLES
COPIES = 200_000  # digests that a task remembers to send the keys of equal sets once; bounds memory, never results


def _distinct(keys: np.ndarray) -> np.ndarray:
    ordered = np.sort(keys)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, borders): each document's distinct shingles, ascending."""
    n = len(offsets) - 1
    starts, ends = words(data, offsets)
    owner = owners(offsets, starts)
    hashes = span_hashes(data, starts, ends, lower=True)
    first, keys = windows(hashes, owner, width)
    of = owner[first]
    counts = per_document(owner, n)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begins = np.cumsum(counts) - counts
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] = mix(extra[has] * np.uint64(0xA24BAED4963EE407) + hashes[begins[short[has]] + k] + np.uint64(k + 1))
        of, keys = np.concatenate([of, short]), np.concatenate([keys, extra])
        order = np.argsort(of, kind="stable")
        of, keys = of[order], keys[order]
    at = np.searchsorted(of, np.arange(n + 1))
    sets = [_distinct(keys[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else keys), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


class Levels:
    """Size levels for a threshold of ``percent``: sets that may link are of one level or of two adjoining ones.

    The parts of level i serve the pairs within level i - 1 and those of level i - 1 with level i.
    """

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1, 2]

    def _grow(self) -> None:
        self.starts.append(self.starts[-1] * 100 // self.percent + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        while self.starts[-1] <= sizes.max(initial=1):
            self._grow()
        return np.searchsorted(self.starts, sizes, "right") - 1

    def parts(self, level: int) -> tuple[int, int]:
        """(parts of the hash space, keys of a document) at a level; (0, 0) where only equal sets can link."""
        while len(self.starts) < level + 2:
            self._grow()
        most = (self.starts[level] + self.starts[level + 1] - 2) * (100 - self.percent) // (100 + self.percent)
        return (most + 1 + (35 * (most + 1) + 99) // 100 + 3, most + 1) if most else (0, 0)


@lru_cache(4)
def levels(percent: int) -> Levels:
    return Levels(percent)


def part_keys(shingles: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, borders) of the sets shingles[at[i]:at[i + 1]]: a set meets every set that it may link with under one."""
    table, sizes = levels(percent), np.diff(at)
    own = table.of(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for step in (0, 1):
        shape = {int(x): table.parts(int(x)) for x in np.unique(own + step)}
        parts, wanted = (np.array([shape[int(x)][k] for x in own + step], np.int64).reshape(-1) for k in (0, 1))
        wanted[sizes == 0] = 0
        live = wanted[doc] > 0
        of = doc[live]
        if not len(of):
            continue
        part = (shingles[live] % parts[of].astype(np.uint64)).astype(np.int64)
        order = np.argsort(of << 32 | part)
        of, part = of[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (of[1:] != of[:-1])]))
        count, sums = np.diff(np.append(first, len(of))), np.add.reduceat(mix(shingles[live][order]), first)
        of, part = of[first], part[first]
        lacking = np.flatnonzero(np.bincount(of, minlength=len(sizes)) < wanted)  # empty parts come in, the weakest
        if len(lacking):
            begins, ends = np.searchsorted(of, lacking), np.searchsorted(of, lacking, "right")
            empty = [np.setdiff1d(np.arange(parts[i]), part[a:b]) for i, a, b in zip(lacking.tolist(), begins.tolist(), ends.tolist(), strict=True)]
            lengths = [len(x) for x in empty]
            of, part = np.concatenate([of, np.repeat(lacking, lengths)]), np.concatenate([part, *empty])
            count, sums = np.concatenate([count, np.zeros(sum(lengths), np.int64)]), np.concatenate([sums, np.zeros(sum(lengths), np.uint64)])
        keys = mix(sums + mix(part.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (own[of] + step + 1).astype(np.uint64)))
        order = np.lexsort((keys, -count, of))
        of, keys = of[order], keys[order]
        strong = np.arange(len(of)) - np.searchsorted(of, of) < wanted[of]
        found.append((of[strong], keys[strong]))
    if not found:
        return shingles[:0], np.zeros(len(at), np.int64)
    of, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(of, kind="stable")
    return keys[order], np.searchsorted(of[order], np.arange(len(at)))


def bitmaps(shingles: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The token bitmaps of the sets, as rows of 64-bit words."""
    out = np.zeros((len(at) - 1, bits), bool)
    out[np.repeat(np.arange(len(at) - 1), np.diff(at)), (shingles >> np.uint64(40)).astype(np.int64) % bits] = True
    return np.packbits(out, axis=1).view(np.uint64)


def _lists(flat: np.ndarray, borders: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(flat.reshape(-1).view(np.int64)))


_FEATURES = "doc_id long, n_shingles long, set1 long, set2 long, map array<long>, keys array<long>"


def _features(width: int, percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("map", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1), SLICE):
                flat, at = shingle_sets(data, offsets, width)
                sizes = np.diff(at)
                digests = []
                for salt in (0x632BE59BD9B4E019, 0xE220A8397B1DCDAF):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(salt)))])
                    digests.append(mix(sums[at[1:]] - sums[at[:-1]] + sizes.astype(np.uint64)).view(np.int64))
                ids = batch.column(0).slice(a, b - a).cast(pa.int64())
                fresh = np.zeros(b - a, bool)
                for i, (digest, known) in enumerate(zip(zip(*(d.tolist() for d in digests), strict=True), ids.is_valid().to_pylist(), strict=True)):
                    if known and digest not in sent:
                        if len(sent) >= COPIES:
                            sent.clear()
                        sent.add(digest)
                        fresh[i] = True
                kept = np.repeat(fresh, sizes)
                keys, key_at = part_keys(flat[kept], np.concatenate([[0], np.cumsum(np.where(fresh, sizes, 0))]).astype(np.int64), percent)
                maps = bitmaps(flat, at, BITS)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(digests[0]), pa.array(digests[1]), _lists(maps, np.arange(b - a + 1) * (BITS // 64)), _lists(keys, key_at)], schema=schema)

    return run


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def unite(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class SignatureTree:
    """Nodes over documents ordered by size and bitmap: OR bitmap, least and largest size, least number of set bits."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        bits = min(max(BITS, 1 << int(4 * np.median(self.sizes)).bit_length()), 1 << 16)
        maps = bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum(self.sizes)]), bits)
        self.order = np.lexsort((maps[:, 0], self.sizes))
        self.levels: list[tuple[np.ndarray, ...]] = []
        maps, low, high, pop = maps[self.order], self.sizes[self.order], self.sizes[self.order], np.bitwise_count(maps[self.order]).sum(1).astype(np.int64)
        self.levels.append((maps, low, high, pop))
        width = LEAF
        while len(maps) > 1:
            first = np.arange(0, len(maps), width)
            maps = np.bitwise_or.reduceat(maps, first, axis=0)
            low, high, pop = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.minimum.reduceat(pop, first)
            self.levels.append((maps, low, high, pop))
            width = FANOUT

    def children(self, level: int, node: int) -> range:
        width = LEAF if level == 1 else FANOUT
        return range(node * width, min((node + 1) * width, len(self.levels[level - 1][1])))

    def may_link(self, level: int, u: int, vs: np.ndarray, percent: int) -> np.ndarray:
        """Which of the nodes vs can hold a document that links with one under u."""
        maps, low, high, pop = self.levels[level]
        common = np.bitwise_count(maps[u] & maps[vs]).sum(1).astype(np.int64)
        overlap = np.minimum(high[u] - np.maximum(0, pop[u] - common), high[vs] - np.maximum(0, pop[vs] - common))
        return (overlap * (100 + percent) >= percent * (low[u] + low[vs])) & (np.maximum(low[u], low[vs]) * percent <= 100 * np.minimum(high[u], high[vs]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def spanning_links(sets: list[np.ndarray], groups: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect what the sets' links connect, groups (equal numbers) counting as connected already."""
    tree, forest, out = SignatureTree(sets), Forest(len(sets)), []
    first: dict[int, int] = {}
    for i, g in enumerate(groups):
        forest.unite(first.setdefault(g, i), i)
    apart = len(first)
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack and apart > 1:
        level, u, v = stack.pop()
        if level == 0:
            i, j = int(tree.order[u]), int(tree.order[v])
            if forest.find(i) != forest.find(j) and linked(sets[i], sets[j], percent) and forest.unite(i, j):
                out.append((i, j))
                apart -= 1
            continue
        right = np.array(tree.children(level, v))
        for x in tree.children(level, u):
            ys = right[right > x - (level > 1)] if u == v else right
            if len(ys):
                stack += [(level - 1, x, int(y)) for y in ys[tree.may_link(level - 1, x, ys, percent)]]
    return out


def _compare(width: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            flat = members.flatten()
            ids, labels, texts = flat.field("doc_id").to_numpy(zero_copy_only=False), flat.field("label").to_numpy(zero_copy_only=False), flat.field("text")
            borders = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            edges: list[tuple[int, int]] = []
            for s, e in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                sets: list[np.ndarray] = []
                for _, _, data, offsets in text_slices(texts.slice(s, e - s)):
                    shingles, at = shingle_sets(data, offsets, width)
                    sets += [shingles[p:q] for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                own, named = ids[s:e].tolist(), labels[s:e].tolist()
                edges += [(own[i], own[j]) for i, j in spanning_links(sets, named, percent)]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], schema=schema)

    return run


def _perhaps_named(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """The rows of docs whose id's place in a bitmap of 2^NAMED places is that of an id of tasks: all that tasks name.

    Only the bitmap, whose size is fixed, is broadcast; ids that share a place come along, and the join drops them.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << NAMED))
    bucket, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1))
    maps = tasks.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    rows = docs.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(maps), "_bucket")
    return rows.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).drop("_bucket", "_bit", "_map")


def _joined(tasks: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links found by tasks (t1, t2, doc_id, label) over the texts of docs (doc_id, text)."""
    stored = materialize(tasks, "tasks")
    rows = stored.join(_perhaps_named(docs, stored), "doc_id").select("t1", "t2", F.struct("doc_id", "label", "text").alias("member"))
    found = rows.groupBy("t1", "t2").agg(F.collect_list("member").alias("members")).select("members").mapInArrow(_compare(width, percent), "a long, b long")
    with batches_of(docs.sparkSession, TASKS):
        out = materialize(found, "links")
    discard(stored)
    return out


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, doc_id) in order: the rows of keys with several documents, and the range's first and last key's."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64())])
    none = np.zeros(0, np.int64)
    key = ids = none
    at_start = True

    def out(key: np.ndarray, ids: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        keep = np.diff(np.append(first, len(key))) > 1
        keep[0] |= at_start
        keep[-1] |= last
        chosen = np.repeat(keep, np.diff(np.append(first, len(key))))
        return key[chosen], ids[chosen]

    for batch in batches:
        key, ids = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((key, ids)))
        if not len(key):
            continue
        whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if not whole and len(key) > 10_000:  # a key of many documents: hand on all but the last row
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1]), pa.array(ids[:-1])], schema=schema)
            key, ids, at_start = key[-1:], ids[-1:], True
        elif whole:
            rows = out(key[:whole], ids[:whole], False)
            at_start = False
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], schema=schema)
            key, ids = key[whole:], ids[whole:]
    if len(key):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out(key, ids, True)], schema=schema)


def _documents_may_link(bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, other_bits: np.ndarray, other_sizes: np.ndarray, other_labels: np.ndarray, percent: int) -> np.ndarray:
    """Which documents (rows) may link with which others (columns) of another label, by their bitmaps and sizes."""
    common = np.bitwise_count(bits[:, None] & other_bits[None]).sum(2).astype(np.int64)
    rest, other_rest = (np.bitwise_count(b).sum(1).astype(np.int64) for b in (bits, other_bits))
    overlap = np.minimum(sizes[:, None] - np.maximum(0, rest[:, None] - common), other_sizes[None] - np.maximum(0, other_rest[None] - common))
    return (overlap * (100 + percent) >= percent * (sizes[:, None] + other_sizes)) & (labels[:, None] != other_labels)


_MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int64())]))
_BLOCKS = "key long, block long, low_label long, high_label long, low long, high long, least_bits long, map array<long>, members array<struct<doc_id:long,label:long>>, near array<struct<doc_id:long,label:long>>, sizes array<long>, maps array<long>"
_BLOCK_ROWS = 512  # blocks in a batch


def _blocks(percent: int, most_docs: int, most_shingles: int):
    """Of (key, label, n, doc_id, map) in order: blocks of one key, with their node's bitmap and ranges.

    ``near`` are the members that by their bitmaps may link with a member of another label.
    """
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int64()), _MEMBERS, _MEMBERS, pa.list_(pa.int64()), pa.list_(pa.int64())]
    schema = pa.schema(list(zip((x.split(" ")[0] for x in _BLOCKS.split(", ")), kinds, strict=True)))

    def block(number: int, held: list[tuple[int, ...]], maps: list[np.ndarray]) -> tuple:
        keys, labels, sizes, ids = (np.array(x) for x in zip(*held, strict=True))
        bits = np.array(maps)
        members = [{"doc_id": i, "label": x} for i, x in zip(ids.tolist(), labels.tolist(), strict=True)]
        may = _documents_may_link(bits, sizes, labels, bits, sizes, labels, percent)
        near = [members[i] for i in np.flatnonzero(may.any(1)).tolist()]
        least = int(np.bitwise_count(bits).sum(1).min())
        node = np.bitwise_or.reduce(bits).view(np.int64).tolist()
        return int(keys[0]), number, int(labels.min()), int(labels.max()), int(sizes.min()), int(sizes.max()), least, node, members, near, sizes.tolist(), bits.view(np.int64).ravel().tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, shingles = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int, ...]] = []
        maps: list[np.ndarray] = []
        done: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            flat = batch.column(4).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            for row, bits in zip(rows, flat, strict=True):
                if held and (held[-1][0] != row[0] or len(held) >= most_docs or shingles + row[2] > most_shingles):
                    done.append(block(number, held, maps))
                    number, shingles, held, maps = number + 1, 0, [], []
                    if len(done) >= _BLOCK_ROWS:
                        yield batch_of()
                        done.clear()
                held.append(row)
                maps.append(bits)
                shingles += row[2]
        if held:
            done.append(block(number, held, maps))
            yield batch_of()

    return run


def _may_meet(percent: int) -> Column:
    """Whether blocks x and y can hold a link that isn't known: the tree's bounds on two nodes, in Spark's functions."""
    common = F.aggregate(F.zip_with("x.map", "y.map", lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda acc, v: acc + v)
    side = lambda s: F.col(f"{s}.high") - F.greatest(F.lit(0), F.col(f"{s}.least_bits") - common)
    overlap = F.least(side("x"), side("y")) * (100 + percent) >= percent * (F.col("x.low") + F.col("y.low"))
    sizes = F.greatest("x.low", "y.low") * percent <= 100 * F.least("x.high", "y.high")
    return overlap & sizes & (F.least("x.low_label", "y.low_label") != F.greatest("x.high_label", "y.high_label"))


def _cut(rows: DataFrame, some: DataFrame, percent: int) -> DataFrame:
    """Blocks of (key, doc_id, label), with the number of blocks of each key."""
    rows = materialize(rows, "open")
    # All sets of an id: rows that share one are one vertex.
    nodes = some.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "set1", "set2"])
    rows = rows.join(nodes, "doc_id").select("key", "label", "n_shingles", "doc_id", "map")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("key", "label", "n_shingles", "doc_id")
    blocks = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_blocks(percent, BLOCK_DOCS // 2, BLOCK_SHINGLES // 2), _BLOCKS), "blocks")
    return blocks.join(blocks.groupBy("key").agg(F.count("*").alias("n_blocks")), "key")


def _narrowed(percent: int):
    """Of pairs of blocks (key, x, y and both blocks' members, sizes and maps): the members that may link across."""
    schema = pa.schema([("key", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("members", _MEMBERS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = []
            for first in (3, 6):
                members, sizes, maps = (batch.column(first + k) for k in range(3))
                at = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                flat = members.flatten()
                ids, labels = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "label"))
                sides.append((at, ids, labels, sizes.flatten().to_numpy(zero_copy_only=False), maps.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), -1)))
            (p, own, own_labels, own_sizes, own_maps), (q, ids, labels, sizes, maps) = sides
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                a, b = slice(p[i], p[i + 1]), slice(q[i], q[i + 1])
                may = _documents_may_link(own_maps[a], own_sizes[a], own_labels[a], maps[b], sizes[b], labels[b], percent)
                if may.any():
                    left, right = np.flatnonzero(may.any(1)) + p[i], np.flatnonzero(may.any(0)) + q[i]
                    for k in range(3):
                        out[k].append(batch.column(k)[i].as_py())
                    out[3].append([{"doc_id": d, "label": x} for d, x in zip([*own[left].tolist(), *ids[right].tolist()], [*own_labels[left].tolist(), *labels[right].tolist()], strict=True)])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types, strict=True)], schema=schema)

    return run


def _meeting(blocks: DataFrame, percent: int) -> DataFrame:
    """(key, x, y, members): pairs of different blocks of one key that may hold a link, and the members that may have one."""
    large = blocks.where("n_blocks > 1")
    x, y = large.alias("x"), large.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") < F.col("y.block")) & _may_meet(percent))
    sides = pairs.select("x.key", F.col("x.block").alias("x"), F.col("y.block").alias("y"), *(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "xy" for c in ("members", "sizes", "maps")))
    with batches_of(blocks.sparkSession, 8 * TASKS):
        return materialize(sides.mapInArrow(_narrowed(percent), "key long, x long, y long, members array<struct<doc_id:long,label:long>>"), "pairs")


def _open_tasks(meets: DataFrame, found: DataFrame, some: DataFrame, percent: int) -> DataFrame:
    """Tasks (t1, t2, doc_id, label) for what the first round leaves open."""
    labels = found.select(F.col("node").alias("doc_id"), "component")
    labelled = meets.join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    blocks = _cut(labelled.join(open_keys, "key", "left_semi"), some, percent)
    within = blocks.where("size(near) > 1").select(F.col("near.doc_id").alias("ids"))
    across = _meeting(blocks, percent).select(F.col("members.doc_id").alias("ids"))
    ids = within.unionByName(across).select(F.array_sort(F.array_distinct("ids")).alias("ids"))
    met = materialize(ids.select(F.col("ids")[0].alias("a"), F.explode("ids").alias("b")).distinct(), "bundles")
    bundles = connected_components(met)
    members = bundles.select(F.col("component").alias("key"), F.col("node").alias("doc_id")).join(labels, "doc_id", "left")
    blocks = _cut(members.select("key", "doc_id", F.coalesce("component", "doc_id").alias("label")), some, percent)
    one = blocks.where("size(near) > 1").select("key", F.col("block").alias("x"), F.col("block").alias("y"), F.array_distinct("near").alias("members"))
    two = _meeting(blocks, percent).select("key", "x", "y", F.array_distinct("members").alias("members"))
    return one.unionByName(two).select(F.col("x").alias("t1"), F.col("y").alias("t2"), F.explode("members").alias("m")).select("t1", "t2", "m.doc_id", "m.label")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    features = materialize(texts.mapInArrow(_features(width, percent), _FEATURES), "shingles")
    some = features.where("doc_id IS NOT NULL AND n_shingles > 0")
    vertices = some.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"))
    named = materialize(some.join(vertices, ["set1", "set2"]).select("doc_id", "rep", "set1", "set2"), "vertices")
    again = named.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")  # one id, several sets
    same_id = again.select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(named.join(again, "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))

    keys = some.select(F.explode("keys").alias("key"), "doc_id")
    shared = materialize(keys.repartitionByRange(n, "key", "doc_id").sortWithinPartitions("key", "doc_id").mapInArrow(_shared, "key long, doc_id long"), "shared")
    met = materialize(shared.join(named.select("doc_id", "rep").distinct(), "doc_id").select("key", F.col("rep").alias("doc_id")).distinct(), "met")
    hubs = met.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub <> last").select("key", "hub")
    meets = materialize(met.join(hubs, "key"), "meets")
    discard(shared, met)

    stars = meets.where("doc_id <> hub").groupBy("doc_id").agg(F.min("hub").alias("hub"))
    stars = stars.join(some.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id")
    stars = materialize(stars, "stars")
    chunks = stars.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("chunks"))
    points = stars.join(chunks, "hub").select(F.col("hub").alias("t1"), F.pmod(F.xxhash64("doc_id"), "chunks").alias("t2"), "doc_id", F.col("doc_id").alias("label"))
    centres = points.select("t1", "t2", F.col("t1").alias("doc_id"), F.col("t1").alias("label")).distinct()
    links = _joined(points.unionByName(centres), texts, width, percent).unionByName(same_id)
    found = connected_components(links)
    more = _joined(_open_tasks(meets.select("key", "doc_id"), found, some, percent), texts, width, percent)
    found = connected_components(links.unionByName(more))

    rows = features.select("doc_id", "n_shingles", "set1", "set2").join(named.select("set1", "set2", "rep").distinct(), ["set1", "set2"], "left")
    out = rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_group(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component; documents without words or id stay."""
    found = jaccard_components(docs, width, percent, id_col, text_col)
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(stays, docs[id_col].cast("long").eqNullSafe(stays._id), "left_semi")
