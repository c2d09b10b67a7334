"""Operator 1, MinHash near-dedup with sequential Bayesian verification.

A document is the set of its distinct five-word shingles (lower-cased A-Z, words cut at ASCII white space). Two
documents are linked when 100 * |A & B| >= 75 * |A | B|. The steps:

1. One pass over the texts makes a sketch per document: the size of its set, a 128-bit key of its word sequence, and
   128 MinHash values. Documents with the same key are one class; only the smallest doc_id of a class goes on.
2. The values are cut into 32 bands of 4. Classes that agree on a band share a bucket. At similarity 0.75 a pair
   shares no bucket with probability (1 - 0.75**4)**32, 5e-6.
3. Every member of a bucket is compared with the bucket's smallest member only, so a bucket of n gives n - 1 pairs.
   Signatures are compared 16 values at a time: under a uniform prior the posterior probability that the similarity
   is 0.75 or more is a binomial tail, and a pair goes when it falls below ``miss``. Survivors are verified exactly
   on their full sets, with the texts joined to the pairs (each text is shuffled once for each pair it is in).
4. Each linked class takes the least label within a few links. A bucket whose members have one label is settled.
   In the others a link may run between members other than the smallest, so their members are dealt into blocks of
   bounded shingles and members, and one task has each pair of blocks of a bucket with their texts. It compares members
   of different labels, drops pairs by step 3's test, leaves a pair to the first bucket that it shares, and verifies the
   rest exactly, most similar first; a link joins two labels within the task, and later pairs within one label are
   skipped. With many members only those are compared that have one of their rarest shingles in common, as linked sets
   must. So what leaves a task is a forest of links, less than one a member, whatever the number of pairs.
   A bucket of more than MEMBERS members isn't dealt into pairs of blocks. The members of all such buckets make a row for
   each of their rarest shingles instead, a quarter of a set or so, and only those meet that share one and differ in
   label. Among those of a shingle, members of its commonest label aren't paired with each other. So rows grow with the
   shingles of the members, not with the square of their number.
5. Connected components of the labels, by alternating large-star and small-star steps on a written edge table.

Edge cases. Null text, empty text or white space only: an empty set, n_shingles 0, its own component. Fewer than
five words: the whole sequence is one shingle. Repeated texts: one class, linked. Repeated doc_ids are taken as rows
of one document: the row with the fewest shingles, then the smallest key, counts. Rows without doc_id are one document of their own: component null,
kept, linked with nothing. Extra columns, whatever their names, are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import Scratch, WordHashes, broadcast_if_small, mix, text_bytes

SHINGLE, BANDS, ROWS, STEP = 5, 32, 4, 16
HASHES = BANDS * ROWS
#: Shingles and members of a block in step 4; a task holds two blocks at a time, about 8 MB of sets, as much text and 16 MB
#: of signatures. Up to ALL_PAIRS members are compared each with each, more through an index.
#: A bucket of more than MEMBERS goes by its members' rarest shingles.
BLOCK, MEMBERS, ALL_PAIRS = 500_000, 16_000, 1500
_rng = np.random.default_rng(20240611)
_MULT = (_rng.integers(1, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a document's shingles."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = hashes(words)
    n = len(h) - SHINGLE + 1
    x = h[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        x += h[k : n + k] * _PLACE[k]
    return np.unique(mix(x))


def signature(shingles: np.ndarray) -> bytes:
    """128 MinHash values. The hashed shingles are uniform, so each affine map's minimum is any member's alike."""
    least, x = np.full(HASHES, 2**32 - 1, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        y = np.multiply.outer(_MULT, x[at : at + 4096])
        y += _ADD[:, None]
        np.minimum(least, y.min(axis=1), out=least)
    return least.tobytes()


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, key (null for an empty set), signature."""
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, keys, sigs = [], [], []
            for text in text_bytes(b.column(1)):
                words = _words(text)
                s = shingle_set(words, hashes)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sigs.append(signature(s) if words else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], schema=out)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_shingles long, key binary, sig binary")


def least_matches(similarity: float, miss: float) -> dict[int, int]:
    """For each number n of compared values the fewest matches m with P(J >= similarity | m of n) >= miss.

    Under a uniform prior that posterior is P(Binomial(n + 1, similarity) <= m).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        below = 0.0
        for m in range(n + 2):
            below += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if below >= miss:
                out[n] = m
                break
    return out


def _survive(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which rows of signatures pass every batch."""
    alive, got = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n in range(STEP, HASHES + 1, STEP):
        got[alive] += (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(axis=1, dtype=np.int32)
        alive = alive[got[alive] >= least[n]]
        if not len(alive):
            break
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def likely(pairs: DataFrame, sigs: DataFrame, least: dict[int, int]) -> DataFrame:
    """The pairs (a, b) whose signatures pass the sequential test."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                keep = pa.array(_survive(_signatures(t.column(2)), _signatures(t.column(3)), least))
                yield pa.RecordBatch.from_arrays([t.column(0).take(keep), t.column(1).take(keep)], schema=out)

    left = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets. ``docs``: doc_id and text of the documents in pairs."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, own = WordHashes(), None, np.empty(0, np.uint64)
        for t in batches:
            a, b, keep = t.column(0).to_pylist(), t.column(1), []
            for i, (x, ta, tb) in enumerate(zip(a, text_bytes(t.column(2)), text_bytes(t.column(3)), strict=True)):
                if x != last:
                    last, own = x, shingle_set(_words(ta), hashes)
                other = shingle_set(_words(tb), hashes)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], schema=out)

    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def hop_labels(links: DataFrame) -> DataFrame:
    """(doc_id, label) of every linked document: the least id within four links or so, by two rounds of jumping."""
    both = links.union(links.select("b", "a"))
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc_id"), F.least("a", "m").alias("label"))
    for _ in range(2):
        of = label.select(F.col("doc_id").alias("label"), F.col("label").alias("next"))
        label = label.join(of, "label").select("doc_id", F.col("next").alias("label"))
    return label


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(label, component) of every node of an edge table (a, b): the smallest node that it reaches.

    Alternates large-star and small-star until no edge changes, so the rounds grow with the logarithm of the nodes.
    A star's centre is one key with many rows: the minimum is taken before the shuffle, and the join that follows
    is one that adaptive execution may split.
    """
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    files = lambda n: n // 1_000_000 + 1
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = state(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select("e.*")
        then = scratch.table(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(files(seen[0])))
        scratch.drop(now)
        now, before, seen = then, seen, state(then)
        if seen == before:
            break
    nodes = now.select(F.col("a").alias("label"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("label"), F.col("b").alias("component")).distinct())


class _Index:
    """Of sets of shingles those that may be linked with a given one.

    Shingles are ordered by frequency. Of a set of n the first n - ceil(2 s n / (1 + s)) + 1 are indexed at similarity s,
    and a set looks up its first n - ceil(s n) + 1: linked sets meet when the larger looks for the smaller.
    """

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, percent: int):
        self.sizes, self.labels = np.array([len(s) for s in sets]), labels
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        back, n = np.unique(flat, return_inverse=True, return_counts=True)[1:]
        order = np.lexsort((back, n[back], owner))
        rank, size = np.arange(len(order)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes), np.repeat(self.sizes, self.sizes)
        held = order[rank < size - -(-2 * percent * size // (100 + percent)) + 1]
        held = held[np.lexsort((owner[held], back[held]))]
        self.owner, token = owner[held], back[held]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        least, most = np.minimum.reduceat(labels[self.owner], starts), np.maximum.reduceat(labels[self.owner], starts)
        asked = order[rank < size - -(-percent * size // 100) + 1]
        self.asks = np.searchsorted(owner[asked], np.arange(len(sets) + 1))  # ``order`` goes by owner
        at = np.searchsorted(token[starts], back[asked])
        at[at == len(starts)] = 0
        own = labels[owner[asked]]
        use = (token[starts][at] == back[asked]) & ~((least[at] == own) & (most[at] == own))
        self.start, self.stop = np.where(use, starts[at], 0), np.where(use, np.append(starts[1:], len(token))[at], 0)

    def __call__(self, x: int) -> np.ndarray:
        a, b = self.asks[x], self.asks[x + 1]
        found = [self.owner[i:j] for i, j in zip(self.start[a:b].tolist(), self.stop[a:b].tolist(), strict=True) if j > i]
        if not found:
            return self.owner[:0]
        y = np.unique(np.concatenate(found))
        return y[(self.sizes[y] < self.sizes[x]) | ((self.sizes[y] == self.sizes[x]) & (y < x))]


def _forest(own: np.ndarray, i: int, j: int, band: int | None, ids: np.ndarray, labels: np.ndarray, sigs: np.ndarray, texts: list[bytes], least: dict[int, int], percent: int, rank: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between blocks i and j (or within i) that join different labels, each joining two that were apart.

    With a band, only pairs that share no earlier one; with ranks, only pairs whose ranks go as i and j do.
    """
    hashes, sets, up = WordHashes(), {}, {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def members(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = shingle_set(_words(texts[x]), hashes)
        return sets[x]

    bands, links = sigs.reshape(-1, BANDS, ROWS), []
    left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j)) if i != j else (np.arange(len(own)),) * 2
    index = _Index([members(x) for x in range(len(own))], labels, percent) if len(own) > ALL_PAIRS else None
    for x in left.tolist() if index is None else range(len(own)):
        y = index(x) if index is not None else right[right > x] if i == j else right
        y = y[(labels[y] != labels[x]) & ((own[y] != own[x]) | (i == j))]
        y = y if rank is None else y[(rank[y] > rank[x]) == (own[y] > own[x])]
        if not len(y):
            continue
        y = y[_survive(np.broadcast_to(sigs[x], (len(y), HASHES)), sigs[y], least)]
        y = y[(bands[y] == bands[x]).all(axis=2).argmax(axis=1) == band] if rank is None else y
        for z in y[np.argsort(-(sigs[y] == sigs[x]).sum(axis=1), kind="stable")].tolist():
            p, q = root(int(labels[x])), root(int(labels[z]))
            if p != q:
                a, b = members(x), members(z)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    up[p] = q
                    links.append((int(ids[x]), int(ids[z])))
    return links


def rare_shingles(members: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(token, doc_id, label, n, held): the rarest shingles of each member (doc_id, label) that others have too.

    Of a set of n a member asks for its first n - ceil(s n) + 1 shingles by frequency and is held under the first
    n - ceil(2 s n / (1 + s)) + 1: of two sets linked at similarity s the larger asks for a shingle that holds the smaller.
    """
    names = "doc_id long, label long, part long, n long, token long"
    out = pa.schema([(c.split()[0], pa.int64()) for c in names.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows, count = [], 0
            for doc, label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), strict=True):
                shingles = shingle_set(_words(text), hashes).view(np.int64)
                part = xxhash.xxh3_64_intdigest(text) >> 1
                for at in range(0, len(shingles), 100_000):
                    some = shingles[at : at + 100_000]
                    rows.append(np.vstack([np.broadcast_to(np.array([[doc], [label], [part], [len(shingles)]]), (4, len(some))), some]))
                    count += len(some)
                    if count >= 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.hstack(rows)], schema=out)
                        rows, count = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.hstack(rows)], schema=out)

    every = scratch.table(texts.join(members, "doc_id").select("doc_id", "label", "text").mapInArrow(run, names))
    common = every.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    # Rows of one doc_id with other texts are sets of their own; equal rows have equal ranks.
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "part").orderBy(F.coalesce("f", F.lit(1)), "token"))
    ranked = every.join(common, "token", "left").withColumn("rank", rank).where("f > 1")
    first = lambda up, down: F.expr(f"n - ({up} * n + {down} - 1) div {down} + 1")
    return ranked.where(F.col("rank") <= first(percent, 100)).select("token", "doc_id", "label", "n", (F.col("rank") <= first(2 * percent, 100 + percent)).alias("held"))


def dealt_by_shingle(rows: DataFrame, block: int = BLOCK, most: int = MEMBERS) -> DataFrame:
    """(token, way, i, j, own, doc_id, label, n): who of ``rare_shingles`` meets whom; own 0 meets own 1 of the same key.

    Pairs of different labels have a member outside the token's commonest label. Way a: held members outside it meet all
    larger ones; way b: members outside it meet held smaller ones of it. Each side is dealt into blocks of bounded shingles and members, so if
    nearly all have one label, or few are held, one side is a single block and the other is sent once.
    """
    labels = rows.groupBy("token", "label").agg(F.count("*").alias("n"), F.sum("n").alias("s"), F.count_if("held").alias("h"), F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("hs"))
    groups = labels.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n", "s", "h", "hs")), F.max(F.struct("n", "label", "s", "h", "hs")).alias("top"))
    groups = groups.where("n > top.n AND h > 0")
    size = lambda n, s: F.greatest(F.lit(1), F.ceil(F.expr(n) / most), F.ceil(F.expr(s) / block)).cast("int")
    groups = groups.select("token", F.col("top.label").alias("top"), F.expr("h > top.h").alias("a"), F.expr("top.h > 0").alias("b"), size("h - top.h", "hs - top.hs").alias("a0"), size("n", "s").alias("a1"), size("n - top.n", "s - top.s").alias("b0"), size("top.h", "top.hs").alias("b1"))

    def place(way: str, own: int, where: str):
        return F.when(F.expr(where), F.struct(F.lit(way).alias("way"), F.lit(own).alias("own"), F.col(f"{way}{own}").alias("mine"), F.col(f"{way}{1 - own}").alias("others")))

    places = F.array(place("a", 0, "held AND label <> top"), place("a", 1, "a"), place("b", 0, "b AND label <> top"), place("b", 1, "held AND label = top"))
    placed = rows.join(groups, "token").select("token", "doc_id", "label", "n", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p")).select("token", "doc_id", "label", "n", "p.*")
    placed = placed.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.col("mine")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    i, j = F.when(F.col("own") == 0, F.col("at")).otherwise(F.col("other")), F.when(F.col("own") == 0, F.col("other")).otherwise(F.col("at"))
    return placed.select("token", "way", i.alias("i"), j.alias("j"), "own", "doc_id", "label", "n")


def unresolved_links(members: DataFrame, sketch: DataFrame, texts: DataFrame, least: dict[int, int], percent: int, block: int = BLOCK, most: int = MEMBERS) -> DataFrame:
    """Links (a, b) that join the labels of the members (bucket, band, doc_id, label) of each bucket with several.

    A bucket of s shingles and at most ``most`` members is dealt into ceil(s / block) blocks; each member goes to every pair
    of blocks that has its own, and one task has one pair of blocks. The members of larger buckets meet by their rarest
    shingles; a pair of them is linked if it is, whether or not it shares a bucket.
    """
    scratch = Scratch(members.sparkSession, "near-dup-open")
    sized = members.join(sketch.select("doc_id", "n_shingles"), "doc_id")
    sizes = sized.groupBy("bucket").agg(F.sum("n_shingles").alias("s"), F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    sizes = scratch.table(sizes.where("lo <> hi").select("bucket", "n", F.ceil(F.col("s") / block).cast("int").alias("blocks")))
    sigs = sketch.select("doc_id", "sig")

    def compare(key, t):
        t = t.sort_by("doc_id")
        column = lambda c: t.column(c).to_numpy()
        i, j, band, rank = key[1].as_py(), key[2].as_py(), None, None
        if "way" in t.column_names:
            # By set size, then id: side 0 has the smaller of a pair in way a, the larger in way b.
            i, j, rank = 0, 1, np.argsort(np.lexsort((column("doc_id"), column("n"))))
            rank = rank if key[1].as_py() == "a" else -rank
        else:
            band = t.column("band")[0].as_py()
        links = _forest(column("own"), i, j, band, column("doc_id"), column("label"), _signatures(t.column("sig")), list(text_bytes(t.column("text"))), least, percent, rank)
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = members.join(sizes.where(F.col("n") <= most), "bucket").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "band", "doc_id", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    links = dealt.join(sigs, "doc_id").join(texts, "doc_id").groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")
    large = sizes.where(F.col("n") > most)
    if large.take(1):
        within = scratch.table(members.join(large, "bucket", "left_semi").select("doc_id", "label").distinct())
        rows = scratch.table(rare_shingles(within, texts, percent, scratch))
        by_shingle = dealt_by_shingle(rows, block, most).join(sigs, "doc_id").join(texts, "doc_id")
        links = links.union(by_shingle.groupBy("token", "way", "i", "j").applyInArrow(compare, "a long, b long"))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.75, miss: float = 1e-6) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``similarity`` is the least Jaccard similarity of a link, in whole percent; ``miss`` bounds the posterior
    probability at which a batch drops a pair.
    """
    spark, percent = docs.sparkSession, round(similarity * 100)
    scratch, least = Scratch(spark, "near-dup"), least_matches(percent / 100, miss)
    sketch = scratch.table(sketches(docs, id_col, text_col))
    classes = scratch.table(sketch.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep")))
    firsts = sketch.join(classes, [sketch.key == classes.key, sketch.doc_id == classes.rep], "left_semi").select("doc_id", "n_shingles", "sig")
    firsts = scratch.table(firsts.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "sig")).alias("s")).select("doc_id", "s.*"))

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.col("sig").substr(k * (ROWS * 4) + 1, F.lit(ROWS * 4))))
    bands = firsts.select("doc_id", F.posexplode(band).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("bucket", "first")
    members = scratch.table(bands.join(shared, "bucket"))
    pairs = scratch.table(likely(members.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct(), firsts, least))
    ids = scratch.table(members.select("doc_id").distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(broadcast_if_small(ids, 16 * ids.count()), "doc_id", "left_semi")
    links = scratch.table(verified(pairs, texts, percent))
    labels = scratch.table(hop_labels(links))
    open_members = members.select("bucket", "band", "doc_id").join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    more = scratch.table(unresolved_links(open_members, firsts, texts, least, percent))

    of = labels.select(F.col("doc_id").alias("b"), F.col("label").alias("label_b"))
    joined = links.union(more).join(of, "b", "left").join(of.toDF("a", "label_a"), "a", "left")
    apart = scratch.table(joined.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b").distinct())
    known = labels.union(more.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(labels, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("label")))
    found = components(apart, scratch) if apart.take(1) else None
    parts = known.withColumnRenamed("label", "component") if found is None else known.join(found, "label", "left").select("doc_id", F.coalesce("component", "label").alias("component"))

    whole = sketch.select("doc_id", "n_shingles", "key").groupBy("doc_id").agg(F.min(F.struct("n_shingles", "key")).alias("s")).select("doc_id", "s.*")
    reps = classes.join(parts.withColumnRenamed("doc_id", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    out = whole.join(reps, "key", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    result = scratch.table(out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
    scratch.drop(sketch, classes, firsts, members)
    return result


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id.

    Here rows are told apart by id and text, so an id with several texts, or none, doesn't take unrelated texts with it:
    of a repeated id the row with the least hash goes by the id, the others by numbers above all ids. Equal rows are one.
    """
    scratch, taken = Scratch(docs.sparkSession, "one-of-each"), "__number" + "_" * sum(c.startswith("__number") for c in docs.columns)
    first = taken + "_first"
    own, text = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    repeated = scratch.table(docs.groupBy(own.alias(taken)).agg(F.min(text).alias(first), F.count("*").alias("n")).where(f"n > 1 OR `{taken}` IS NULL").drop("n"))
    n = repeated.count()
    if n:
        above = docs.agg(F.max(own)).first()[0] or 0
        other = F.lit(above + 1) + F.pmod(F.xxhash64(own, F.col(text_col).cast("string")), F.lit(1 << 61))
        joined = docs.join(broadcast_if_small(repeated, 32 * n), own.eqNullSafe(F.col(taken)), "left").drop(taken)
        number = F.when(F.col(first).isNull(), own).when(own.isNotNull() & (text == F.col(first)), own).otherwise(other)
        joined = scratch.table(joined.withColumn(taken, number))
        docs = joined.where(F.col(first).isNull()).union(joined.where(F.col(first).isNotNull()).dropDuplicates([taken])).drop(first)
    else:
        docs = docs.withColumn(taken, own)
    gone = near_duplicates(docs, taken, text_col).where("NOT kept").select(F.col("doc_id").alias(taken))
    return docs.join(broadcast_if_small(gone, 16 * gone.count()), taken, "left_anti").drop(taken)
