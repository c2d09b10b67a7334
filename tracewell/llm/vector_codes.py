"""Operator 12, vector codes by dual-tree Lloyd.

Vectors become integers (``floor(scale * x)``), are cut into equal consecutive parts, and each part position gets a
codebook: the parts of the first vectors by id, moved by a few rounds of Lloyd's algorithm in integers. A vector's code
is the index of the nearest entry of each part.

Assignment compares two trees. Parts of a block of rows form a tree for each position, built once: halves by the median
of the widest component, with each node's box, row count and component sums cached. The entries of a codebook form
another one. Pairs of nodes are walked down together, all positions at once: the distance between two boxes bounds what
any of their pairs can have, so an entry node farther than the farthest that another one can be is pruned. A part node
with one entry left is assigned whole, from its cached sums; the parts of a leaf with several left are compared with
these in integers. Bounds are integers too, and only a strictly larger distance prunes, so results are those of comparing
every part with every entry.

Blocks of rows with their trees are a written table that all rounds read. A round sends at most parts * entries sums a
task, and codebooks (parts * entries * width numbers) are all that the driver and the tasks hold of the whole.

Edge cases. Rows whose vector is null or holds null, NaN or an infinity have no code and are left out. Vectors shorter
than the longest, or whose length isn't a multiple of the number of parts, are filled up with zeros; an empty one is all
zeros. Components are held within plus and minus 2**k, with k from the part's width (2**29 for four), so that distances
fit 64 bits. The first vectors are the smallest by id, null ids last, ties by their components; with fewer rows there
are fewer entries. Repeated rows and ids are rows of their own. Ties between entries go to the lower index. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.shared import Scratch, broadcast_if_small

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block, and parts of a leaf of its trees, or so.
BLOCK_ROWS, LEAF = 8192, 16
#: Pairs of parts and entries that are compared at a time.
PAIRS_AT_ONCE = 200_000


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(id, label, v): the usable rows' vectors as integers, filled up to one length, a multiple of ``parts``."""
    kept = vectors.where(usable(F.col(vector_col)))
    longest = kept.agg(F.max(F.size(vector_col))).first()[0] or 0
    width = max(1, -(-longest // parts))
    most = float(2 ** ((62 - (width - 1).bit_length()) // 2 - 1))
    whole = F.transform(vector_col, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(most)), F.lit(-most)).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(width * parts) - F.size(vector_col))))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return kept.select(F.col(id_col).alias("id"), label.alias("label"), filled.alias("v"))


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Entries by part, entry and position: the vectors with the smallest ids (at most ``entries`` rows)."""
    found = [r.v for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    width = len(found[0]) // parts if found else 1
    return np.array(found, np.int64).reshape(len(found), parts, width).transpose(1, 0, 2).copy()


class Tree:
    """A tree over each position's points: level d has 2**d nodes, each a run of the points in the tree's order.

    ``x`` is (positions, points, width); ``order`` (positions, points) says which point stands where. Every node has its
    box; leaves are the last level.
    """

    def __init__(self, x: np.ndarray, leaf: int, order: np.ndarray | None = None):
        """``x`` in any order; or, with the ``order`` that a tree had, already in that order."""
        positions, n, _ = x.shape
        self.depth = max(0, (-(-n // leaf) - 1).bit_length())
        self.bounds = [np.arange((1 << d) + 1) * n >> d for d in range(self.depth + 1)]
        known, rows = order is not None, np.arange(positions)[:, None]
        order = order if known else np.tile(np.arange(n), (positions, 1))
        for d in range(0 if known else self.depth):  # each node's points are sorted by its widest component, so its halves are runs
            at = self.bounds[d]
            now = x[rows, order]
            spread = np.maximum.reduceat(now, at[:-1], axis=1) - np.minimum.reduceat(now, at[:-1], axis=1)
            node = np.repeat(np.arange(1 << d), np.diff(at))
            key = np.take_along_axis(now, np.repeat(spread.argmax(2), np.diff(at), axis=1)[..., None], 2)[..., 0]
            order = order[rows, np.lexsort((key, np.broadcast_to(node, key.shape)), axis=1)]
        self.order, self.x = order, x if known else x[rows, order]
        self.low = [np.minimum.reduceat(self.x, b[:-1], axis=1) for b in self.bounds]
        self.high = [np.maximum.reduceat(self.x, b[:-1], axis=1) for b in self.bounds]


def _between(a_low, a_high, b_low, b_high) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest squared distance between points of two boxes, row by row."""
    gap = np.maximum(np.maximum(a_low - b_high, b_low - a_high), 0)
    far = np.maximum(a_high - b_low, b_high - a_low)
    return (gap * gap).sum(1), (far * far).sum(1)


def nearest(tree: Tree, codebooks: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """What is assigned of all positions: (position, first, end, entry) of whole runs of points, and single points as runs of one.

    Each point of each position is in one run.
    """
    positions, n_entries, _ = codebooks.shape
    spare = (1 << (n_entries - 1).bit_length()) - n_entries  # copies of the last entry, which loses ties against it
    codebooks = np.concatenate([codebooks, np.repeat(codebooks[:, -1:], spare, axis=1)], axis=1)
    books = Tree(codebooks, 1)
    pos, node, entry = np.arange(positions), np.zeros(positions, np.int64), np.zeros(positions, np.int64)  # pairs of nodes that are left
    for level in range(max(tree.depth, books.depth) + 1):
        d, e = min(level, tree.depth), min(level, books.depth)
        low, high = _between(tree.low[d][pos, node], tree.high[d][pos, node], books.low[e][pos, entry], books.high[e][pos, entry])
        at = pos * (1 << d) + node  # pairs are sorted by it
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        runs = np.diff(np.r_[first, len(at)])
        stays = low <= np.repeat(np.minimum.reduceat(high, first), runs)
        pos, node, entry, at = pos[stays], node[stays], entry[stays], at[stays]
        if e == books.depth:
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            alone = np.diff(np.r_[first, len(at)]) == 1
            one = first[alone]
            yield pos[one], tree.bounds[d][node[one]], tree.bounds[d][node[one] + 1], books.order[pos[one], entry[one]]
            more = np.repeat(~alone, np.diff(np.r_[first, len(at)]))
            pos, node, entry = pos[more], node[more], entry[more]
            if not len(pos):
                return
        if level < max(tree.depth, books.depth):
            a, b = (2 if d < tree.depth else 1), (2 if e < books.depth else 1)
            first = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (node[1:] != node[:-1])])
            runs = np.repeat(np.diff(np.r_[first, len(pos)]), a)
            # the pairs of a node's first half, then those of its second, so they stay sorted
            take = np.repeat(np.repeat(first, a) - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            half = np.repeat(np.arange(len(runs)) % a, runs)
            pos, node, entry = np.repeat(pos[take], b), np.repeat(node[take] * a + half, b), (entry[take][:, None] * b + np.arange(b)).ravel()
    # leaves with several entries left: each point against each of them, in the order of their indexes
    d, entry = tree.depth, books.order[pos, entry]
    order = np.lexsort((entry, node, pos))
    pos, node, entry = pos[order], node[order], entry[order]
    first = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (node[1:] != node[:-1])])
    runs = np.diff(np.r_[first, len(pos)])
    size = np.diff(tree.bounds[d])[node[first]]
    for s, e in _slices(runs * size, PAIRS_AT_ONCE):
        n, r, p = size[s:e], np.repeat(runs[s:e], size[s:e]), np.repeat(pos[first[s:e]], size[s:e])
        point = np.repeat(tree.bounds[d][node[first[s:e]]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.cumsum(r) - r  # a point's pairs
        own = np.repeat(np.repeat(first[s:e], n) - at, r) + np.arange(r.sum())
        found = entry[own]
        distance = np.zeros(len(own), np.int64)
        for k in range(tree.x.shape[2]):
            gap = np.repeat(tree.x[p, point, k], r) - codebooks[pos[own], found, k]
            distance += gap * gap
        least = np.flatnonzero(distance == np.repeat(np.minimum.reduceat(distance, at), r))
        whose = np.repeat(np.arange(len(r)), r)[least]
        least = least[np.r_[True, whose[1:] != whose[:-1]]]  # the first of equals has the lowest index
        yield p, point, point + 1, found[least]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes add up to ``most`` or so."""
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
    yield from zip(cuts[:-1], cuts[1:])


def _split(v: np.ndarray, parts: int) -> np.ndarray:
    """Rows of whole vectors as (parts, rows, width)."""
    return v.reshape(len(v), parts, -1).transpose(1, 0, 2)


def planted(rows: DataFrame, parts: int = PARTS, block_rows: int = BLOCK_ROWS, leaf: int = LEAF) -> DataFrame:
    """(ids, labels, x, ord): blocks of rows, their parts in the order of each position's tree."""
    kind = rows.schema["label"].dataType
    ids, labels = rows.schema["id"].dataType, kind
    schema = T.StructType([T.StructField("ids", T.ArrayType(ids)), T.StructField("labels", T.ArrayType(labels)), T.StructField("x", T.BinaryType()), T.StructField("ord", T.BinaryType())])

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).astype(np.int64)
        tree = Tree(_split(v, parts), leaf)
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks())
        cells = [one("id"), one("label"), pa.array([tree.x.astype("<i4").tobytes()], pa.binary()), pa.array([tree.order.astype("<i4").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cells, names=["ids", "labels", "x", "ord"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                dims = len(b.column(2)[0])
                most = max(leaf, block_rows * 64 // max(dims, 64))  # wide vectors: fewer of them
                now = b.slice(0, most - n)
                b = b.slice(now.num_rows)
                held.append(now)
                n += now.num_rows
                if n == most:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return rows.select("id", "label", "v").mapInArrow(run, schema)


def _trees(batches: Iterator[pa.RecordBatch], parts: int, leaf: int) -> Iterator[tuple[pa.RecordBatch, int, Tree]]:
    for b in batches:
        for i in range(b.num_rows):
            order = np.frombuffer(b.column(3)[i].as_py(), "<i4").reshape(parts, -1).astype(np.int64)
            x = np.frombuffer(b.column(2)[i].as_py(), "<i4").reshape(*order.shape, -1).astype(np.int64)
            yield b, i, Tree(x, leaf, order)


def moved(blocks: DataFrame, codebooks: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The codebooks after one round: each entry is the floor of the mean of the parts nearest to it, or stays."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for _, _, tree in _trees(batches, parts, leaf):
            sums = np.zeros((parts, tree.x.shape[1] + 1, width), np.int64)  # of a node, or any run: the difference of two
            np.cumsum(tree.x, axis=1, out=sums[:, 1:])
            for pos, first, end, entry in nearest(tree, codebooks):
                np.add.at(total, (pos, entry), np.column_stack([sums[pos, end] - sums[pos, first], end - first]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    new = np.zeros(parts * entries * (width + 1), np.int64)
    for r in blocks.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # the size of the codebooks
        new[r["at"]] = r.n
    new = new.reshape(parts, entries, width + 1)
    n = new[..., -1:]
    return np.where(n > 0, new[..., :-1] // np.maximum(n, 1), codebooks)


def learn(blocks: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS, leaf: int = LEAF) -> np.ndarray:
    for _ in range(rounds if codebooks.size else 0):
        codebooks = moved(blocks, codebooks, leaf)
    return codebooks


def encode(blocks: DataFrame, codebooks: np.ndarray, leaf: int = LEAF) -> DataFrame:
    """(id, label, code, error) of every row: entry indexes in hexadecimal, two digits or more each, and the squared distance."""
    parts, entries, _ = codebooks.shape
    digits = max(2, -(-max(entries - 1, 1).bit_length() // 4))
    id_type, label_type = (blocks.schema[c].dataType.elementType for c in ("ids", "labels"))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, tree in _trees(batches, parts, leaf):
            n = tree.x.shape[1]
            found = np.empty((parts, n), np.int64)
            for pos, first, end, entry in nearest(tree, codebooks):
                size = end - first
                found[np.repeat(pos, size), np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(entry, size)
            gap = tree.x - codebooks[np.arange(parts)[:, None], found]
            code, error = np.empty((n, parts), np.int64), np.zeros(n, np.int64)
            for p in range(parts):
                code[tree.order[p], p] = found[p]
                error[tree.order[p]] += (gap[p] * gap[p]).sum(1)
            if digits == 2:
                text = code.astype(np.uint8).tobytes().hex()
                codes = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
            else:
                codes = ["".join(f"{x:0{digits}x}" for x in row) for row in code.tolist()]
            cells = [b.column(0)[i].values, b.column(1)[i].values, pa.array(codes, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(cells, names=["id", "label", "code", "error"])

    return blocks.mapInArrow(run, schema)


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error) of every usable row, final codebooks)."""
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    rows = quantised(vectors, id_col, vector_col, label_col, scale, parts)
    codebooks = first_codebooks(rows, parts, entries)
    blocks = scratch.table(planted(rows, parts))
    codebooks = learn(blocks, codebooks, rounds)
    codes = scratch.table(encode(blocks, codebooks))
    scratch.drop(blocks)
    return codes, codebooks


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error: the errors of all rows of the same label, null being one of them."""
    sums = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    n = sums.count()
    return codes.join(broadcast_if_small(sums, 64 * n), F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
