"""What the operators of this subpackage share: written tables, checked broadcasts, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.storage import shared_folder

#: A side of a join is broadcast only after its bytes have been counted and found to be no more than this.
BROADCAST_BYTES = 32 << 20
#: Words are runs of anything but these six ASCII characters; ``bytes.split()`` cuts at the same six.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Texts that are Python objects at a time, of the rows of an Arrow batch.
TEXTS_AT_ONCE = 256
#: Rows and bytes of the Arrow batches that tasks exchange with Python while a scratch table is written.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}

_made: list[list[Scratch]] = []


class Scratch:
    """Tables written to the shared folder to cut lineage, so a lost executor costs a reread and no recomputation.

    ``drop`` removes the tables that later ones have made useless; what the caller's result still reads stays, until the
    ``released`` block around the call ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.n = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", 0
        for held in _made[-1:]:
            held.append(self)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/t{self.n}"
        with self._small_batches():
            df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    @contextmanager
    def _small_batches(self) -> Iterator[None]:
        """Lowers the session's Arrow batches to ARROW_BATCH; smaller ones stay, and all come back afterwards."""
        conf, size = self.spark.conf, self.spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        before = {k: conf.get(k) for k in ARROW_BATCH}
        try:
            for k, v in before.items():
                if not 0 < size(v) <= ARROW_BATCH[k]:
                    conf.set(k, str(ARROW_BATCH[k]))
            yield
        finally:
            for k, v in before.items():
                conf.set(k, v)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def close(self) -> None:
        self._delete(self.base)


@contextmanager
def released() -> Iterator[None]:
    """Removes the tables that operators wrote within the block; write what is still wanted before it ends."""
    _made.append([])
    try:
        yield
    finally:
        for s in _made.pop():
            s.close()


def broadcast_if_small(df: DataFrame, nbytes: int) -> DataFrame:
    """A broadcast hint where the counted bytes allow it; else Spark shuffles both sides."""
    return F.broadcast(df) if nbytes <= BROADCAST_BYTES else df


def text_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """Bytes of each text, null as empty; a few at a time, so a batch isn't held twice."""
    column = column.cast(pa.binary())
    for at in range(0, len(column), TEXTS_AT_ONCE):
        for x in column.slice(at, TEXTS_AT_ONCE).to_pylist():
            yield x or b""


class WordHashes:
    """Two independent 64-bit hashes of words. The cache is emptied when full, so a task's memory stays bounded."""

    def __init__(self, most: int = 200_000):
        self.most, self.at, self.lanes = most, {}, np.empty((0, 2), np.uint64)

    def _places(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        except KeyError:
            distinct = set(words)
            new = [w for w in distinct if w not in self.at]
            if len(self.at) + len(new) > self.most:
                self.at, new = {}, list(distinct)
            n = len(self.at)
            if n + len(new) > len(self.lanes):
                grown = np.empty((max(2 * len(self.lanes), n + len(new), 4096), 2), np.uint64)
                grown[:n] = self.lanes[:n]
                self.lanes = grown
            self.lanes[n : n + len(new)] = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, new)), np.uint64).reshape(-1, 2)
            self.at.update(zip(new, range(n, n + len(new))))
            return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        at = self._places(words)
        return self.lanes[at, 0]

    def both(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = self._places(words)
        return self.lanes[at, 0], self.lanes[at, 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def native_words(text: Column) -> Column:
    """Words of a text as an array, by built-in functions (null: no words)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
