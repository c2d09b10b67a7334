"""Operator 8, token counts by an exact length histogram.

Each document is encoded and only its length kept; documents are counted by length (first within each task), and sums
over the histogram from either end answer every context limit: documents and tokens at most that long, documents over
it, tokens left after truncation there, and the quantile. Sums run over blocks of lengths, each within its own window,
on top of the sums of the blocks before; so no task sees more than a block of lengths or the list of blocks.

Edge cases. Null or empty text: length 0. Repeated rows count each. Texts of any length are encoded whole, bytes that aren't UTF-8 as
U+FFFD. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewell.llm.shared import text_bytes

BLOCK = 4096
_ENCODINGS: dict = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoding(path: str):
    if path not in _ENCODINGS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def encoded_lengths(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(length) of each row's text in tokens."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t.decode("utf-8", "replace"))) for t in text_bytes(b.column(0))], pa.int64())], names=["length"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs)."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def limits(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per length that occurs, taken as a context limit; ``at_limits`` answers any other.

    Columns: length, n_docs, docs_at_most, tokens_at_most, docs_over, tokens_over, truncated_tokens (each document cut
    at the limit), quantile (share of documents at most that long), total_tokens. ``histogram`` is read twice.
    """
    rows = histogram.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / block))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = sums.select("block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "dt"), *(F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"))
    within = W.partitionBy("block").orderBy("length").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = rows.withColumn("dw", F.sum("n_docs").over(within)).withColumn("tw", F.sum("tokens").over(within)).join(blocks, "block")
    at = at.withColumn("docs_at_most", F.col("d_before") + F.col("dw")).withColumn("tokens_at_most", F.col("t_before") + F.col("tw"))
    over = F.col("d_all") - F.col("docs_at_most")
    return at.select(
        "length", "n_docs", "docs_at_most", "tokens_at_most", over.alias("docs_over"), (F.col("t_all") - F.col("tokens_at_most")).alias("tokens_over"),
        (F.col("tokens_at_most") + F.col("length") * over).alias("truncated_tokens"), (F.col("docs_at_most") / F.col("d_all")).alias("quantile"), F.col("t_all").alias("total_tokens"),
    )


def at_limits(histogram: DataFrame, asked: list[int]) -> DataFrame:
    """One row per asked context limit, whether a document has that length or not, by one aggregation.

    Columns: context_limit, docs_at_most, tokens_at_most, docs_over, tokens_over, truncated_tokens, quantile (null without documents).
    """
    n, tokens = F.col("n_docs"), F.col("length") * F.col("n_docs")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")

    def answer(limit: int) -> Column:
        within = F.col("length") <= limit
        d, t, over, rest = (total(F.when(within if k < 2 else ~within, c)) for k, c in enumerate((n, tokens, n, tokens)))
        return F.struct(F.lit(limit).cast("long").alias("context_limit"), d.alias("docs_at_most"), t.alias("tokens_at_most"), over.alias("docs_over"), rest.alias("tokens_over"), (t + limit * over).alias("truncated_tokens"), F.try_divide(d, d + over).alias("quantile"))

    return histogram.agg(F.array(*map(answer, asked)).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def lengths_at(histogram: DataFrame, quantiles: list[float]) -> DataFrame:
    """(quantile, length): the smallest length that at least that share of the documents doesn't exceed."""
    rows = limits(histogram)
    found = rows.agg(F.array(*(F.struct(F.lit(float(q)).alias("quantile"), F.min(F.when(F.col("quantile") >= q, F.col("length"))).alias("length")) for q in quantiles)).alias("a"))
    return found.select(F.explode("a").alias("a")).select("a.*")
