"""Operator 9, substring dedup behind a count-min prefilter.

A window is 50 consecutive words of one document (words cut at ASCII white space, otherwise unchanged). Every word
covered by a window whose word sequence also starts in a document with a smaller doc_id is removed.

1. First pass over the texts. A window's sketch key is the least hash of the 8-word grams inside it. Equal windows
   have equal keys, and a document's windows share few of them, so a position is counted once however many windows
   choose it: about one key for 20 words. Each partition counts its keys in its own count-min sketch of two rows, kept
   sparse and cut into blocks; blocks of all partitions are added up. An estimate never falls short of the number of
   positions with that key, which never falls short of the number of occurrences of a window, so none is lost. The
   sketch has four cells a row for each expected key, whatever the size of the corpus.
2. The summed sketch is reduced to two bits a cell, "at least 2" and "at least HOT", and written. Up to ``SENT_BYTES``
   these bits are broadcast and looked up in the second pass. Beyond, they stay where they are: the documents' distinct
   keys are joined with the cells that are set, and the repeated keys come back to their documents by a join. Both ways
   find the same windows.
3. Second pass. Windows estimated to occur twice or more are emitted with a 128-bit hash of their word sequence, once
   for each document with all positions there, and grouped exactly on the hash. A window estimated below HOT occurs
   fewer than HOT times, so its group is bounded. The others, which may stand in a third of all documents, are dealt by
   hash and a salt of the document: what isn't the first of its salted group is decided there, and a second round
   compares the firsts of the salts alone, one row a salt.
4. Repeated windows come back as positions, which are united into word spans for each document and text; these short
   spans, not the texts, are moved: broadcast if their counted bytes are small, else both sides are shuffled.

Window hashes are two lanes of 64 bits made from independent word hashes by scrambling at each doubling, so two
different windows share both with a probability of about 2**-128 each pair; the words themselves aren't compared.

Edge cases. Null, empty or short text (under 50 words): no window, nothing removed. A window that is repeated only
within one document stays. Repeated rows with one doc_id count as one document: nothing of them is removed on each
other's account, and each row loses what its own text repeats (rows are told apart by a 64-bit hash of their text). Rows
without doc_id neither lose words nor make others lose any. Bytes that aren't UTF-8 pass through. Extra columns are
ignored by ``repeated_spans`` and kept by ``remove_repeats``, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tracewell.llm.shared import BROADCAST_BYTES, Scratch, WordHashes, broadcast_if_small, mix, text_bytes

WINDOW, GRAM, DEPTH, BLOCK_BITS, HOT = 50, 8, 2, 18, 1000
#: Two bits for each cell of the sketch are broadcast up to so many bytes.
SENT_BYTES = BROADCAST_BYTES
#: Words hashed together, keys counted together, and windows emitted together.
CHUNK, HELD, EMITTED = 30_000, 500_000, 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive entries of h, from hashes of runs of 1, 2, 4 ... entries."""
    out, have, x, w = None, 0, h, 1
    while True:
        if width & w:
            out = x if out is None else mix(out[: len(x) - have] * _ODD + x[have:])
            have += w
        if have == width:
            return out
        if len(x) <= w or len(h) < width:
            return np.empty(0, np.uint64)
        x = mix(x[:-w] * _ODD + x[w:])
        w *= 2


def in_reach(x: np.ndarray, reach: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest (``pick``) of each ``reach`` consecutive entries, by doubling."""
    width = 1
    while width * 2 <= reach:
        x = pick(x[:-width], x[width:])
        width *= 2
    rest = reach - width
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def sketched(h: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, keys, valid) of the windows of documents that lie in ``h`` one after the other.

    A window's key is the least gram hash in it; windows that run over a document's end aren't valid.
    """
    if len(h) < WINDOW:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, bool),)
    grams = run_hashes(h, GRAM)
    ends = np.repeat(np.cumsum(sizes), sizes)[: len(h) - WINDOW + 1]
    return grams, in_reach(grams, WINDOW - GRAM + 1, np.minimum), ends - np.arange(len(ends)) >= WINDOW


def positions_counted(grams: np.ndarray, keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Keys to count: one entry for each gram position whose value is the least of some valid window over it.

    Every position that ties for a window's minimum counts, so a key counts at least as often as windows with it: of two
    windows one starts later, and so does its first least gram. The greatest key of the windows over a position is its
    own value if and only if it is such a position.
    """
    reach = WINDOW - GRAM + 1
    if not len(keys):
        return keys
    edge = np.zeros(reach - 1, np.uint64)
    return grams[in_reach(np.concatenate([edge, np.where(valid, keys, np.uint64(0)), edge]), reach, np.maximum) == grams]


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each key in a row of the sketch."""
    return mix(keys + np.uint64((row + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))) >> np.uint64(64 - bits)


def sketch_bits(n_words: int) -> int:
    """log2 of the cells in a row: 4 for each expected key (one for 20 words), 2**18 at least."""
    return max(BLOCK_BITS, (4 * (n_words // 20 + 1) - 1).bit_length())


def _chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[bytes], list[int]]]:
    """(batch, row numbers, words, words of each row) of documents with a window, CHUNK words or so at a time."""
    for b in batches:
        rows, words, sizes = [], [], []
        for i, text in enumerate(text_bytes(b.column(text_at))):
            own = text.split()
            if len(own) >= WINDOW:
                rows.append(i)
                words += own
                sizes.append(len(own))
            if len(words) > CHUNK:
                yield b, rows, words, sizes
                rows, words, sizes = [], [], []
        if rows:
            yield b, rows, words, sizes


_BLOCKS = pa.schema([("block", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])


def partition_sketches(texts: DataFrame, bits: int) -> DataFrame:
    """The sparse sketch of each partition, a row for each block of cells that isn't empty."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(held) if held else np.empty(0, np.uint64)
        for row in range(DEPTH if len(keys) else 0):
            cell, n = np.unique(cells(keys, row, bits), return_counts=True)
            n = np.minimum(n, 2**16 - 1).astype(np.uint16)
            block = (cell >> np.uint64(BLOCK_BITS)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            stops = np.append(starts[1:], len(cell))
            within = (cell & np.uint64(2**BLOCK_BITS - 1)).astype(np.uint32)
            parts = [(block[starts] + (row << (bits - BLOCK_BITS))), [within[s:e].tobytes() for s, e in zip(starts, stops, strict=True)], [n[s:e].tobytes() for s, e in zip(starts, stops, strict=True)]]
            yield pa.RecordBatch.from_arrays([pa.array(p, f.type) for p, f in zip(parts, _BLOCKS, strict=True)], schema=_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = WordHashes(), [], 0
        for _, _, words, sizes in _chunks(batches, 2):
            held.append(positions_counted(*sketched(hashes(words), sizes)))
            n += len(held[-1])
            if n > HELD:
                yield from flush(held)
                held, n = [], 0
        yield from flush(held)

    return texts.mapInArrow(run, "block long, cells binary, counts binary")


def merged_sketch(parts: DataFrame) -> DataFrame:
    """(block, repeated, hot): the added-up blocks as bit maps of cells with counts of at least 2 and at least HOT."""
    out = pa.schema([("block", pa.int64()), ("repeated", pa.binary()), ("hot", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            maps = [pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary()) for least in (2, HOT)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *maps], schema=out)

        block, total = None, np.zeros(1 << BLOCK_BITS, np.int64)
        for t in batches:
            for i in range(t.num_rows):
                b, cell, n = (t.column(k)[i].as_py() for k in range(3))
                if b != block:
                    if block is not None:
                        yield done()
                    block = b
                    total[:] = 0
                total[np.frombuffer(cell, np.uint32)] += np.frombuffer(n, np.uint16)  # a row's cells are distinct
        if block is not None:
            yield done()

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, repeated binary, hot binary")


def _flags(sketch: dict[int, bytes], bits: int) -> np.ndarray:
    """One array of bytes of all rows' bits."""
    size = 1 << (BLOCK_BITS - 3)
    out = np.zeros(DEPTH << (bits - 3), np.uint8)
    for block, data in sketch.items():
        out[block * size : (block + 1) * size] = np.frombuffer(data, np.uint8)
    return out


def _all_rows_set(flags: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for row in range(DEPTH):
        c = cells(keys, row, bits) + np.uint64(row << bits)
        hit &= (flags[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def keys_of_documents(texts: DataFrame, bits: int) -> DataFrame:
    """(doc_id, t, key, c0, c1): the distinct sketch keys of each document with their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b, rows, words, sizes in _chunks(batches, 2):
            _, keys, valid = sketched(hashes(words), sizes)
            at = np.flatnonzero(valid & np.concatenate([[True], (keys[1:] != keys[:-1]) | ~valid[:-1]]))
            row = np.repeat(rows, sizes)[at]
            got = np.unique(np.stack([row.astype(np.uint64), keys[at]]), axis=1)
            took, k = pa.array(got[0].astype(np.int64)), got[1]
            yield pa.RecordBatch.from_arrays([b.column(0).take(took), b.column(1).take(took), pa.array(k.view(np.int64)), *(pa.array(cells(k, r, bits).view(np.int64)) for r in range(DEPTH))], names=["doc_id", "t", "key", "c0", "c1"])

    return texts.mapInArrow(run, "doc_id long, t long, key long, c0 long, c1 long")


def repeated_keys(texts: DataFrame, merged: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """(doc_id, t, keys, hot_keys): packed sketch keys of each document that are estimated to occur twice or more, or HOT times."""

    def set_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                block, repeated, hot = (t.column(k)[i].as_py() for k in range(3))
                at = np.flatnonzero(np.unpackbits(np.frombuffer(repeated, np.uint8), bitorder="little"))
                often = np.unpackbits(np.frombuffer(hot, np.uint8), bitorder="little")[at] == 1
                row, base = block >> (bits - BLOCK_BITS), (block & ((1 << (bits - BLOCK_BITS)) - 1)) << BLOCK_BITS
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row, np.int32)), pa.array(at + base), pa.array(often)], names=["row", "cell", "hot"])

    found = scratch.table(merged.mapInArrow(set_cells, "row int, cell long, hot boolean"))
    own = scratch.table(keys_of_documents(texts, bits))
    kept = own.select("key", "c0", "c1").distinct()
    for row in range(DEPTH):
        kept = kept.join(found.where(F.col("row") == row).select(F.col("cell").alias(f"c{row}"), F.col("hot").alias(f"hot{row}")), f"c{row}")
    kept = kept.select("key", F.expr(" AND ".join(f"hot{row}" for row in range(DEPTH))).alias("hot"))
    both = own.select("doc_id", "t", "key").join(kept, "key").groupBy("doc_id", "t").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot_keys"))
    out = scratch.table(both)
    scratch.drop(found, own)
    return out


_WINDOWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("salt", pa.int32()), ("doc_id", pa.int64()), ("t", pa.int64()), ("pos", pa.int32()), ("more", pa.binary())])


def suspect_windows(texts: DataFrame, salts: int, lookup: Callable[[pa.RecordBatch, list[int], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(h1, h2, salt, doc_id, t, pos, more) of the windows estimated to occur twice or more.

    ``texts``: doc_id, t, text and what ``lookup`` needs to tell which of some keys are repeated, and which hot. A window
    that a document holds several times is one row: its first position, and the others as packed int32. Only hot
    windows have a salt other than 0.
    """

    def found(b: pa.RecordBatch, rows: list[int], words: list[bytes], sizes: list[int], hashes: WordHashes) -> tuple | None:
        low, high = hashes.both(words)
        _, keys, valid = sketched(low, sizes)
        turn = np.concatenate([[True], keys[1:] != keys[:-1]])
        repeated, hot = lookup(b, rows, keys[turn])
        which = np.cumsum(turn) - 1
        pos = np.flatnonzero(repeated[which] & valid)
        if not len(pos):
            return None
        h1, h2 = run_hashes(low, WINDOW)[pos], run_hashes(high, WINDOW)[pos]
        of = np.repeat(np.arange(len(rows)), sizes)[pos]
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = (pos - start[of]).astype(np.int32)
        u = h1 + of.astype(np.uint64) * _ODD
        order = np.argsort(u, kind="stable")
        same = (u[order[1:]] == u[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        firsts = np.flatnonzero(np.concatenate([[True], ~same]))
        n = np.diff(np.append(firsts, len(order)))
        more = [None] * len(firsts)
        for i in np.flatnonzero(n > 1).tolist():
            more[i] = at[order[firsts[i] + 1 : firsts[i] + n[i]]].tobytes()
        first = order[firsts]
        docs = np.array(rows)[of[first]]
        took = pa.array(docs)
        doc_id, t = b.column(0).take(took).to_numpy(), b.column(1).take(took).to_numpy()
        salt = (mix(doc_id.view(np.uint64) * _ODD + t.view(np.uint64)) % np.uint64(salts)).astype(np.int32) + 1
        return h1[first].view(np.int64), h2[first].view(np.int64), np.where(hot[which[pos[first]]], salt, 0).astype(np.int32), doc_id, t, at[first], more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = WordHashes(), [], 0

        def packed() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in list(zip(*held, strict=True))[:-1]]
            more = [x for h in held for x in h[-1]]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(more, pa.binary())], schema=_WINDOWS)

        for b, rows, words, sizes in _chunks(batches, 2):
            got = found(b, rows, words, sizes, hashes)
            if got is not None:
                held.append(got)
                n += len(got[0])
            if n > EMITTED:
                yield packed()
                held, n = [], 0
        if held:
            yield packed()

    return texts.mapInArrow(run, "h1 long, h2 long, salt int, doc_id long, t long, pos int, more binary")


def suspects(texts: DataFrame, scratch: Scratch, salts: int, sent_bytes: int) -> DataFrame:
    """``suspect_windows`` by the sketch of all texts: its bits are broadcast up to ``sent_bytes``, else joined."""
    bits = sketch_bits((texts.agg(F.sum(F.length("text"))).first()[0] or 0) // 6)
    merged = scratch.table(merged_sketch(partition_sketches(texts, bits)))
    if DEPTH << (bits - 2) <= sent_bytes:
        rows = merged.toArrow()  # at most ``sent_bytes``
        block = rows.column("block").to_pylist()
        sent = [texts.sparkSession.sparkContext.broadcast(_flags(dict(zip(block, rows.column(k).to_pylist(), strict=True)), bits)) for k in ("repeated", "hot")]
        repeated, hot = sent

        def look_up(b: pa.RecordBatch, rows: list[int], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            twice = _all_rows_set(repeated.value, keys, bits)
            often = np.zeros(len(keys), bool)
            often[twice] = _all_rows_set(hot.value, keys[twice], bits)
            return twice, often

        return suspect_windows(texts, salts, look_up)

    def join_up(b: pa.RecordBatch, rows: list[int], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        took = pa.array(rows)
        return tuple(np.isin(keys, b.column(k).take(took).flatten().to_numpy().view(np.uint64)) for k in (3, 4))

    known = repeated_keys(texts, merged, bits, scratch)
    return suspect_windows(texts.join(known, ["doc_id", "t"]).select("doc_id", "t", "text", "keys", "hot_keys"), salts, join_up)


def repeated_spans(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", sent_bytes: int | None = None) -> tuple[DataFrame, int]:
    """(doc_id, t, spans) of the rows that lose words, and their bytes.

    t is the xxhash64 of the text, spans are pairs of int32 (first word, word after).
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    windows = suspects(texts, scratch, salts, SENT_BYTES if sent_bytes is None else sent_bytes)

    near = windows.withColumn("first", F.min("doc_id").over(W.partitionBy("h1", "h2", "salt")))
    later, own = F.col("doc_id") > F.col("first"), ["doc_id", "t", "pos", "more"]
    near = near.where(later | (F.col("salt") > 0)).select(*own, later.alias("decided"), *(F.when(~later, F.col(h)).alias(h) for h in ("h1", "h2")))
    near = scratch.table(near)
    rest = near.where("not decided").withColumn("first", F.min("doc_id").over(W.partitionBy("h1", "h2"))).where("doc_id > first")
    positions = near.where("decided").select(*own).union(rest.select(*own))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for at, more in zip(b.column(2), b.column(3), strict=True):
                p = np.unique(np.concatenate([np.array(at.as_py(), np.int32), np.frombuffer(b"".join(more.as_py()), np.int32)]))
                cut = np.flatnonzero(np.diff(p) > WINDOW)
                made.append(np.stack([p[np.r_[0, cut + 1]], p[np.r_[cut, len(p) - 1]] + WINDOW], axis=1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["doc_id", "t", "spans"])

    lost = positions.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("at"), F.collect_set("more").alias("more"))
    spans = scratch.table(lost.mapInArrow(unite, "doc_id long, t long, spans binary"))
    size = spans.agg(F.sum(F.length("spans") + 24)).first()[0] or 0
    scratch.drop(near)
    return spans, size


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with n_words, n_removed and kept_text (kept words joined by one space) added.

    Columns of ``docs`` that have these three names are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    spans, size = repeated_spans(docs, Scratch(docs.sparkSession, "substring-dup"), id_col, text_col)
    made = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    @F.arrow_udf(made)
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        n, gone, left = [], [], []
        for raw, s in zip(text_bytes(text), spans, strict=True):
            words, lost = raw.split(), 0
            n.append(len(words))
            if s.is_valid:
                kept, at = [], 0
                for a, b in np.frombuffer(s.as_py(), np.int32).reshape(-1, 2).tolist():
                    kept += words[at:a]
                    lost, at = lost + b - a, b
                words = kept + words[at:]
            gone.append(lost)
            left.append(b" ".join(words))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.binary()).view(pa.string())], names=made.names)

    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    joined = row.join(broadcast_if_small(spans, size), ["doc_id", "t"], "left")
    # texts that lose nothing stay out of Python, but for those whose bytes string functions would change
    here = F.col("spans").isNull() & F.coalesce(F.is_valid_utf8("text"), F.lit(True))
    both = joined.select("row", "text", here.alias("here"), cut(F.when(~here, F.col("text")), "spans").alias("cut"))
    text = F.coalesce("text", F.lit(""))
    plain = F.struct(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")).alias("kept_text"))
    return both.select("row.*", *(F.when(F.col("here"), plain[c]).otherwise(F.col(f"cut.{c}")).alias(c) for c in made.names))
