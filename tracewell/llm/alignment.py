"""Operator 13, alignment of two tokenizers' ids by their bytes, with corpus-wide counts under a minimal perfect hash.

Tokenizer A is a byte-level BPE, B a piece BPE with byte fallback. Offsets at which tokens of both end cut a text into
groups; every A token of a group is linked with every B token of it, and a pair's count is the number of documents in
which it is linked.

First pass: every task emits the pairs of its documents with their counts so far. The distinct pairs are dealt by hash
into segments, and each segment gets a minimal perfect hash: a pilot a small group of keys moves these to free slots. Counts
are then dense vectors over a segment's slots, made from chunks of the first pass's rows and added up along a tree. A
slot keeps its key, so an unknown pair is told from a known one. Second pass: documents are aligned again and their pairs
looked up.

The tables of pairs that the second pass holds are those of the most frequent pairs, as many as BROADCAST_BYTES allow
(all of them, below that); rarer pairs, which are in few documents each, come by a join. A pair of ids is a number below
the product of the vocabularies' sizes, and the best count of an A id one number per id.

A text is aligned in chunks, cut before single spaces between characters that aren't white space: neither vocabulary has
a token that goes on over such a place, so both tokenizers cut there and a chunk's groups don't depend on its neighbours.
Chunks are looked up in a bounded cache; what isn't in it is encoded, many chunks at a time.

Edge cases. Null and empty texts, and texts whose tokens of A or B don't give back a space and the text (which B's
normalisation can cause, and bytes that aren't UTF-8), have no tokens: zeros and an empty ``groups_sha256``. Special
tokens' strings are plain text. Texts of any length are encoded whole. Repeated rows and ids are documents each. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import BROADCAST_BYTES, TEXTS_AT_ONCE, Scratch, mix, text_bytes

#: Keys of a segment, keys of a group that share a pilot, rows of a chunk of counts, dense vectors that are added at a time.
SEGMENT_KEYS, GROUP_KEYS, CHUNK_ROWS, FAN_IN = 16_384, 4, 1 << 20, 16
#: Chunks of text that are kept with their groups, and chunks of the documents that are looked up together.
CACHED, MOST_PENDING = 400_000, 200_000
_CUT, _TWO = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")


def chunks_of(text: str) -> list[str]:
    """A text cut at single spaces between characters that aren't white space."""
    if text[0] == " " or text[-1] == " " or _TWO.search(text):
        return _CUT.split(text)
    return text.split(" ")


def vocabularies() -> tuple[str, str]:
    """A's vocabulary as ranks of byte strings, which has the ids of its other form, and B's model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def piece_bytes(piece: str) -> bytes:
    """What a piece stands for: <0xHH> for a byte, U+2581 for a space."""
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Aligner:
    """Both tokenizers, and what they make of a chunk."""

    def __init__(self, a_path: str, b_path: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        # without special tokens their strings are plain text
        self.a = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_size = [b""] * (max(ranks.values()) + 1), self.b.get_piece_size()
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b_size)]
        self.sizes = [np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes)]
        # an id with what follows it: at even places within its side of a group, at odd ones at the end of that side
        self.written = [np.array([f"{i}{c}" for i in range(len(own)) for c in (",", end)], object) for own, end in ((self.a_bytes, "|"), (self.b_bytes, ";"))]

    def aligned(self, chunks: list[str], texts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of a space and each chunk: whether its tokens give it back; and of those that do, (n_a, n_b, n_groups, n_links),
        the links as numbers a * size of B + b, all in a row, and the text of the groups if asked for."""
        raw = [(" " + c).encode() for c in chunks]
        of = [[self.a(" " + c) for c in chunks], self.b.encode(chunks, num_threads=1)]
        n = [np.fromiter(map(len, x), np.int64, len(x)) for x in of]
        ids = [np.fromiter(chain.from_iterable(x), np.int64, k.sum()) for x, k in zip(of, n, strict=True)]
        whole = b"".join(raw)
        if any(b"".join(map(own.__getitem__, x.tolist())) != whole for own, x in zip((self.a_bytes, self.b_bytes), ids, strict=True)):
            same = np.array([all(b"".join(map(own.__getitem__, x)) == r for own, x in ((self.a_bytes, y), (self.b_bytes, z))) for y, z, r in zip(*of, raw, strict=True)], bool)
            if not same.all():
                return same, *self.aligned([c for c, s in zip(chunks, same, strict=True) if s], texts)[1:]
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, ids, strict=True)]
        cuts = np.zeros(len(whole) + 1, np.int8)
        for e in ends:
            cuts[e] += 1
        last = [cuts[e] == 2 for e in ends]  # a token that ends where one of the other does
        group = [np.cumsum(x) - x for x in last]
        in_group = [np.bincount(g) for g in group]
        first = [np.cumsum(k) - k for k in in_group]
        pairs = in_group[0] * in_group[1]
        g = np.repeat(np.arange(len(pairs)), pairs)
        k = np.arange(len(g)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        links = ids[0][first[0][g] + k // in_group[1][g]] * self.b_size + ids[1][first[1][g] + k % in_group[1][g]]
        chunk = np.repeat(np.arange(len(chunks)), n[0])[last[0]]  # of each group
        sizes = np.column_stack([*n, np.bincount(chunk, minlength=len(chunks)), np.bincount(chunk, pairs, len(chunks)).astype(np.int64)])
        words = [""] * len(chunks)
        if texts:  # A's ids of a group, then B's, then the next group's
            out = np.empty(len(ids[0]) + len(ids[1]), object)
            at = [np.arange(len(ids[0])) + first[1][group[0]], np.arange(len(ids[1])) + (first[0] + in_group[0])[group[1]]]
            for x, where, end, written in zip(ids, at, last, self.written, strict=True):
                out[where] = written[2 * x + end]
            till, out = np.cumsum(n[0] + n[1]).tolist(), out.tolist()
            words = ["".join(out[i:j]) for i, j in zip([0, *till], till)]
        return np.ones(len(chunks), bool), sizes, links, words


_ALIGNERS: dict = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _ALIGNERS:  # kept while the worker lives; what a task learns isn't
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


class Chunks:
    """Numbers of chunks, and what is known of them in tables; -1 for a chunk that its tokens don't give back.

    Emptied when full, so a task's memory stays bounded. ``more`` makes further columns of new chunks from their links.
    """

    def __init__(self, aligner: Aligner, texts: bool, more=None):
        self.aligner, self.texts, self.more = aligner, texts, more
        self._clear()

    def _clear(self) -> None:
        self.at, self.words, self.n, self.n_links = {}, [], 0, 0
        self.rows, self.links = np.empty((4096, 8), np.int64), np.empty(16384, np.int64)

    def _room(self, table: np.ndarray, n: int) -> np.ndarray:
        if n <= len(table):
            return table
        grown = np.empty((max(n, 2 * len(table)), *table.shape[1:]), table.dtype)
        grown[: len(table)] = table
        return grown

    def _learn(self, new: list[str]) -> None:
        good, sizes, links, words = self.aligner.aligned(new, self.texts)
        k, m = self.n, self.n_links
        self.rows, self.links = self._room(self.rows, k + len(sizes)), self._room(self.links, m + len(links))
        self.links[m : m + len(links)] = links
        own = self.rows[k : k + len(sizes)]
        own[:, :4], own[:, 4] = sizes, m + np.cumsum(sizes[:, 3]) - sizes[:, 3]  # and where a chunk's links begin
        own[:, 5:] = 0
        if self.more:
            own[:, 5:] = self.more(links, np.repeat(np.arange(len(sizes)), sizes[:, 3]), len(sizes))
        self.words += words
        self.n, self.n_links = k + len(sizes), m + len(links)
        self.at.update(zip(new, np.where(good, k + np.cumsum(good) - 1, -1).tolist(), strict=True))

    def __call__(self, chunks: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all chunks of some documents, where each document's begin and the last one's end); a document with a chunk that doesn't come back has none."""
        if self.n > CACHED:
            self._clear()
        flat = list(chain.from_iterable(chunks))
        found = list(map(self.at.get, flat))
        if None in found:
            new = list({c for c, f in zip(flat, found, strict=True) if f is None})
            for s in range(0, len(new), 8192):
                self._learn(new[s : s + 8192])
            found = list(map(self.at.__getitem__, flat))
        out, n = np.array(found, np.int64), np.array(list(map(len, chunks)), np.int64)
        if len(out) and out.min() < 0:
            doc = np.repeat(np.arange(len(n)), n)
            lost = np.zeros(len(n), bool)
            lost[doc[out < 0]] = True
            out, n = out[~lost[doc]], np.where(lost, 0, n)
        return out, np.concatenate([[0], np.cumsum(n)])

    def links_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(links of the chunks one after the other, how many each has)."""
        n, start = self.rows[ids, 3], self.rows[ids, 4]
        return self.links[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def _documents(ids: list, column: pa.Array) -> Iterator[tuple[list, list[list[str]]]]:
    """(ids, chunks of each text) of a few documents at a time; no chunks where there is no text."""
    waiting, chunks, n = [], [], 0
    for doc, raw in zip(ids, text_bytes(column), strict=True):
        try:
            own = chunks_of(raw.decode()) if raw else []
        except UnicodeDecodeError:
            own = []
        waiting.append(doc)
        chunks.append(own)
        n += len(own)
        if n > MOST_PENDING or len(waiting) >= TEXTS_AT_ONCE:
            yield waiting, chunks
            waiting, chunks, n = [], [], 0
    if waiting:
        yield waiting, chunks


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """(pair, n, part): pairs linked in the documents of a part of a task, and in how many of these."""
    paths = paths or vocabularies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs, counts, part = Chunks(_aligner(paths), False), [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
            return keys, np.bincount(at, np.concatenate(counts)).astype(np.int64)

        def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for s in range(0, len(keys), 1 << 16):
                k = keys[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[s : s + (1 << 16)]), pa.array(np.full(len(k), part, np.int32))], names=["pair", "n", "part"])

        for batch in batches:
            for _, chunks in _documents([None] * batch.num_rows, batch.column(0)):
                ids, cut = known(chunks)
                own = np.unique(np.repeat(np.arange(len(chunks)), np.diff(cut)) << 32 | ids)  # a chunk counts once in a document, then a pair
                pair, n = known.links_of(own & 0xFFFFFFFF)
                doc = np.repeat(own >> 32, n)
                once = np.unique(doc << 40 | pair)
                keys, c = np.unique(once & ((1 << 40) - 1), return_counts=True)
                pairs.append(keys)
                counts.append(c)
                if sum(map(len, pairs)) > 2 * CHUNK_ROWS:
                    keys, c = merged()
                    pairs, counts = [keys], [c]
                    if len(keys) > CHUNK_ROWS:
                        yield from out(keys, c)
                        pairs, counts, part = [], [], part + 1
        if pairs:
            yield from out(*merged())

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "pair long, n long, part int").withColumn("part", F.spark_partition_id() * 1000 + F.col("part"))


def _hash(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(np.atleast_1d(np.asarray(seed, np.uint64)) + np.uint64(1)))


def pilots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pilots, keys by slot) of distinct keys: ``slots(keys, pilots, len(keys))`` is a bijection onto 0 to len(keys) - 1.

    Keys are dealt into groups; the largest group first, the smallest pilot is taken that sends its keys to free slots.
    """
    n = len(keys)
    group = (_hash(keys, 1) % np.uint64(max(1, n // GROUP_KEYS))).astype(np.int64)
    order = np.argsort(group, kind="stable")
    first = np.searchsorted(group[order], np.arange(max(1, n // GROUP_KEYS) + 1))
    found, free, held = np.zeros(len(first) - 1, np.uint32), np.ones(n, bool), np.empty(n, np.int64)
    left = n
    for g in np.argsort(-np.diff(first), kind="stable"):
        own = keys[order[first[g] : first[g + 1]]]
        if not len(own):
            break
        base, most = 0, int(min(4096, max(16, 2 * (n / left) ** len(own))))  # about as many as will be needed
        while True:
            tries = np.arange(base, base + most, dtype=np.uint64)
            at = (_hash(own[:, None], tries + np.uint64(2)) % np.uint64(n)).astype(np.int64)  # keys by pilots
            good = free[at].all(0)
            if len(own) > 1 and good.any():
                s = np.sort(at[:, good], axis=0)
                good[good] = (s[1:] != s[:-1]).all(0)
            if good.any():
                break
            base += most
        k = int(good.argmax())
        found[g] = base + k
        free[at[:, k]], held[at[:, k]] = False, own
        left -= len(own)
    return found, held


def slots(keys: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """Each key's slot under the pilots of ``n`` keys; an unknown key gets some slot, too."""
    group = (_hash(keys, 1) % np.uint64(len(found))).astype(np.int64)
    return (_hash(keys, np.uint64(2) + found[group].astype(np.uint64)) % np.uint64(n)).astype(np.int64)


#: A segment is the upper part of a product by an odd number, of 31 bits, so Spark and NumPy get the same one.
_MASK, _ODD = (1 << 31) - 1, 1640531527


def _segment_of(pair: Column, segments: int) -> Column:
    folded = pair.bitwiseXOR(F.shiftright(pair, 31)).bitwiseAND(F.lit(_MASK))
    return F.shiftright((folded * F.lit(_ODD)).bitwiseAND(F.lit(_MASK)) * F.lit(segments).cast("long"), 31).cast("int")


def segments_of(pairs: np.ndarray, segments: int) -> np.ndarray:
    return (((pairs ^ (pairs >> 31)) & _MASK) * _ODD & _MASK) * segments >> 31


_HASHED = "segment int, pilots binary, keys binary"


def hashed(pairs: DataFrame, segments: int) -> DataFrame:
    """(segment, pilots, keys) of distinct pairs: a minimal perfect hash a segment."""

    def build(key, t: pa.Table) -> pa.Table:
        found, held = pilots(np.sort(t.column("pair").to_numpy()))
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "pilots": pa.array([found.tobytes()], pa.binary()), "keys": pa.array([held.tobytes()], pa.binary())})

    return pairs.select("pair", _segment_of(F.col("pair"), segments).alias("segment")).groupBy("segment").applyInArrow(lambda k, t: build(k, t), _HASHED)


def dense_counts(rows: DataFrame, hashes: DataFrame, segments: int, n_rows: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(segment, counts): a number a slot, the sum of n over ``rows`` (pair, n, part), added up along a tree of chunks."""
    chunks = max(1, -(-n_rows // (segments * chunk_rows)))
    dealt = rows.select("pair", "n", _segment_of(F.col("pair"), segments).alias("segment"), F.pmod(F.xxhash64("part"), F.lit(chunks)).cast("int").alias("chunk"))
    spread = hashes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def vector(key, t: pa.Table, h: pa.Table) -> pa.Table:
        out = pa.schema([("segment", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())])
        if not t.num_rows:
            return out.empty_table()
        keys, pair = np.frombuffer(h.column("keys")[0].as_py(), np.int64), t.column("pair").to_numpy()
        at = slots(pair, np.frombuffer(h.column("pilots")[0].as_py(), np.uint32), len(keys))
        if (keys[at] != pair).any():
            raise ValueError("a pair isn't among the distinct ones")
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, t.column("n").to_numpy())
        return pa.table([[key[0].as_py()], [key[1].as_py()], [counts.tobytes()]], schema=out)

    def added(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in t.column("counts"))
        return pa.table({"segment": t.column("segment")[:1], "chunk": pa.array([t.column("chunk")[0].as_py() // FAN_IN], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    sums = dealt.groupBy("segment", "chunk").cogroup(spread.groupBy("segment", "chunk")).applyInArrow(lambda k, t, h: vector(k, t, h), "segment int, chunk int, counts binary")
    while chunks > 1:
        sums = sums.groupBy("segment", F.floor(F.col("chunk") / FAN_IN)).applyInArrow(lambda t: added(t), "segment int, chunk int, counts binary")
        chunks = -(-chunks // FAN_IN)
    return sums.select("segment", "counts")


def pair_rows(tables: DataFrame) -> DataFrame:
    """(pair, n_docs) of hashed segments with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys.as_py(), np.int64)), pa.array(np.frombuffer(counts.as_py(), np.int64))], names=["pair", "n_docs"])

    return tables.select("keys", "counts").mapInArrow(run, "pair long, n_docs long")


class Lookup:
    """Counts of the pairs of some segments; -1 for a pair that isn't among them."""

    def __init__(self, rows: list, segments: int):
        self.segments, self.tables = segments, {}
        for r in rows:
            self.tables[r.segment] = (np.frombuffer(r.pilots, np.uint32), np.frombuffer(r["keys"], np.int64), np.frombuffer(r.counts, np.int64))
        sizes = [len(self.tables[s][1]) if s in self.tables else 0 for s in range(segments)]
        groups = [len(self.tables[s][0]) if s in self.tables else 0 for s in range(segments)]
        self.n, self.start = np.array(sizes, np.int64), np.cumsum([0, *sizes])[:-1]
        self.groups, self.group_start = np.array(groups, np.int64), np.cumsum([0, *groups])[:-1]
        join = lambda i, kind: np.concatenate([self.tables[s][i] for s in sorted(self.tables)]) if self.tables else np.empty(0, kind)
        self.pilots, self.keys, self.counts = join(0, np.uint32), join(1, np.int64), join(2, np.int64)
        del self.tables

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        out, segment = np.full(len(pairs), -1, np.int64), segments_of(pairs, self.segments)
        held = self.n[segment] > 0
        keys, s = pairs[held], segment[held]
        group = (_hash(keys, 1) % self.groups[s].astype(np.uint64)).astype(np.int64)
        pilot = self.pilots[self.group_start[s] + group].astype(np.uint64)
        at = self.start[s] + (_hash(keys, np.uint64(2) + pilot) % self.n[s].astype(np.uint64)).astype(np.int64)
        out[held] = np.where(self.keys[at] == keys, self.counts[at], -1)
        return out


def aligned(docs: DataFrame, lookup, best, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """Each document aligned again, with what ``lookup`` (broadcast) knows of its pairs; ``rest`` holds the others and how often each is linked.

    ``best`` (broadcast) is the highest count of each A id. A row's ``row`` is its own number.
    """
    paths = paths or vocabularies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, top, aligner = lookup.value, best.value, _aligner(paths)
        row = TaskContext.get().partitionId() << 33

        def counted(links: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
            """n_best, count_sum and the number of links that ``table`` doesn't know, of each of n chunks."""
            count = table(links)
            there = count >= 0
            columns = (there & (count == top[links // aligner.b_size]), np.where(there, count, 0), ~there)
            sums = [np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) for c in columns]
            ends = np.cumsum(np.bincount(owner, minlength=n))
            return np.column_stack([s[ends] - s[np.concatenate([[0], ends[:-1]])] for s in sums])

        known = Chunks(aligner, True, counted)
        for batch in batches:
            for ids, chunks in _documents(batch.column(0).to_pylist(), batch.column(1)):
                at, cut = known(chunks)
                sums = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(known.rows[at], axis=0)])
                sums = sums[cut[1:]] - sums[cut[:-1]]
                words = list(map(known.words.__getitem__, at.tolist()))
                digests = [hashlib.sha256("".join(words[i:j])[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(cut.tolist(), cut[1:].tolist())]
                rest = [None] * len(ids)
                for d in np.flatnonzero(sums[:, 7]).tolist():
                    own = at[cut[d] : cut[d + 1]]
                    links, _ = known.links_of(own[known.rows[own, 7] > 0])
                    pair, times = np.unique(links[table(links) < 0], return_counts=True)
                    rest[d] = [{"pair": p, "times": t} for p, t in zip(pair.tolist(), times.tolist(), strict=True)]
                cells = [pa.array(ids, pa.int64()), *map(pa.array, sums[:, [0, 1, 2, 3, 5, 6]].T), pa.array(digests, pa.string()), pa.array(np.arange(row, row + len(ids))), pa.array(rest, _REST)]
                row += len(ids)
                yield pa.RecordBatch.from_arrays(cells, names=_ALIGNED)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, row long, rest array<struct<pair: long, times: long>>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


_REST = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
_ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "row", "rest"]
#: Bytes of a pair in a broadcast table: key, count and its share of a pilot.
PAIR_BYTES = 20


def counted_pairs(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, segment_keys: int = SEGMENT_KEYS, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, int, int]:
    """((segment, pilots, keys, counts), segments, pairs): in how many documents each pair is linked."""
    rows = scratch.table(pair_counts(docs, id_col, text_col, paths))
    distinct = scratch.table(rows.select("pair").distinct())
    n_rows, n = rows.count(), distinct.count()
    tables, segments = _tables(rows, distinct, n_rows, n, segment_keys, chunk_rows, scratch)
    scratch.drop(rows, distinct)
    return tables, segments, n


def _tables(rows: DataFrame, distinct: DataFrame, n_rows: int, n: int, segment_keys: int, chunk_rows: int, scratch: Scratch) -> tuple[DataFrame, int]:
    segments = max(1, -(-n // segment_keys))
    hashes = scratch.table(hashed(distinct, segments))
    out = scratch.table(hashes.join(dense_counts(rows, hashes, segments, n_rows, chunk_rows), "segment"))
    scratch.drop(hashes)
    return out, segments


def frequent(pairs: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` pairs are linked in as many documents."""
    exponent = F.floor(F.log2("n_docs")).cast("int")
    found, held = {r.e: r.n for r in pairs.groupBy(exponent.alias("e")).agg(F.count("*").alias("n")).collect()}, 0  # 64 rows at most
    for e in sorted(found, reverse=True):
        held += found[e]
        if held > most:
            return 1 << (e + 1)
    return 1


def cross_aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, held_bytes: int = BROADCAST_BYTES, segment_keys: int = SEGMENT_KEYS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    spark = docs.sparkSession
    scratch, paths = Scratch(spark, "alignment"), paths or vocabularies()
    tables, segments, n = counted_pairs(docs, scratch, id_col, text_col, paths, segment_keys, chunk_rows)
    pairs = pair_rows(tables)
    a_of = F.floor(F.col("pair") / F.lit(_aligner(paths).b_size)).cast("int")
    highest = pairs.groupBy(a_of.alias("a")).agg(F.max("n_docs").alias("n")).collect()  # a row an id of A
    best = np.zeros(max((r.a for r in highest), default=0) + 1, np.int64)
    for r in highest:
        best[r.a] = r.n
    least = frequent(pairs, held_bytes // PAIR_BYTES) if n * PAIR_BYTES > held_bytes else 1
    held, held_segments = tables, segments
    if least > 1:
        head = scratch.table(pairs.where(F.col("n_docs") >= least).select("pair", F.col("n_docs").alias("n"), F.lit(0).alias("part")))
        k = head.count()
        held, held_segments = _tables(head, head, k, k, segment_keys, max(chunk_rows, k), scratch)
    lookup, tops = spark.sparkContext.broadcast(Lookup(held.collect(), held_segments)), spark.sparkContext.broadcast(best)  # bounded by held_bytes, and by the vocabulary
    out = scratch.table(aligned(docs, lookup, tops, id_col, text_col, paths))
    wanted = [c for c in _ALIGNED if c not in ("row", "rest")]
    if least == 1:
        return out.select(*wanted)
    top = pairs.groupBy(a_of.alias("a")).agg(F.max("n_docs").alias("top"))
    rare = pairs.where(F.col("n_docs") < least).withColumn("a", a_of).join(top, "a")
    more = out.select("row", F.explode("rest").alias("x")).select("row", "x.*").join(rare, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n_docs")).alias("more_sum"), F.sum(F.when(F.col("n_docs") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"))
    out = out.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return out.select(*wanted)
