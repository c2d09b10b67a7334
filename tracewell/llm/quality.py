"""Operator 4, quality rules by the frequency of lines across documents. Built-in functions only.

Counts on the words of a text (runs of anything but ASCII white space) come from one row alone. The trigrams of a
text are packed as hash and position into longs, sorted as primitives, and compared with their neighbours, so a text of
n words costs n log n and no shuffle.

Lines are normalised (lower case, inner white space as one space, trimmed) and hashed to 64 bits. For each host the
distinct documents that hold a line are counted: the pairs (line, document) are aggregated before the shuffle and dealt
by line and document, then counted by line, and no line gathers in one task. A line is frequent in its host if more than
``least_docs`` documents hold it, and the square of their number exceeds ``spread`` times the host's documents: a
template belongs to a part of a host that doesn't grow with the whole, while chance repeats of short lines do, by their
root. One rule holds at every size (20 documents of 160, 50 of 1,000, 223 of 20,000, 3,162 of 4 million). Frequent lines
are removed, and a document that keeps less than ``kept_percent`` of its words is rejected as depleted.

Copies are documents: every line of a text that is copied often enough is frequent, and all its copies are depleted.
Where copies are to be told apart later (as in the pipeline, where operator 1 keeps one of them), ``per="texts"`` weighs
each document by one over the number of its copies in the host: distinct texts are counted.

Edge cases. Null text: no words, fails the base rules, no text of its host. Null host: the host ''. White-space lines are never counted or
removed. Ties don't occur (limits are strict counts). Repeated rows get the same result, once each. Extra columns are
ignored by ``verdicts`` and kept by ``clean``; the names that begin with "__" are taken. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import ASCII_SPACE, Scratch, broadcast_if_small, native_words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
LEAST_DOCS, SPREAD, KEPT_PERCENT = 20, 2.5, 50
#: What a line's holders are counted by.
PER = {"documents": ("__id", "__text"), "texts": ("__text",)}


def _has_word(line: Column) -> Column:
    return F.translate(line, ASCII_SPACE, "") != ""


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), "[\\x20\\x09-\\x0D]+", " ")))


def base_metrics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the counts of each row's ``text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), _has_word)
    bare = F.translate(text, ASCII_SPACE, "")
    first = docs.select(*keep, F.length(bare).cast("long").alias("word_chars"), (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"), native_words(text).alias("w"), lines.alias("lines"))
    own = [*keep, "word_chars", "n_symbols"]
    second = first.select(*own, "w", F.size("w").alias("n"), F.length(F.bin(F.size("w").cast("long"))).alias("b"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    own += ["n_dup_lines"]
    packed = "sort_array(transform(slice(w, 1, greatest(n - 2, 0)), (x, i) -> shiftleft(xxhash64(x, get(w, i + 1), get(w, i + 2)), b) | i))"
    third = second.select(*own, F.col("n").cast("long").alias("n_words"), "b", F.expr(packed).alias("s"))
    own += ["n_words"]
    twice = "sort_array(transform(filter(s, (x, i) -> shiftright(x, b) = shiftright(get(s, i - 1), b) OR shiftright(x, b) = shiftright(get(s, i + 1), b)), x -> x & (shiftleft(1L, b) - 1)))"
    fourth = third.select(*own, F.expr(twice).alias("r"))
    covered = "aggregate(transform(r, (x, i) -> least(3L, coalesce(get(r, i + 1) - x, 3L))), 0L, (a, x) -> a + x)"
    # a generator, since a filter on these counts would otherwise be pushed below and pull the arrays into its lambdas
    counts = F.struct(*own[len(keep) :], F.expr(covered).alias("n_repeat_words"))
    out = fourth.select(*keep, F.explode_outer(F.array(counts)).alias("__counts")).select(*keep, "__counts.*")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def _plain(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("__host"), F.col(text_col).cast("string").alias("text")).withColumn("__text", F.xxhash64("text"))


def hashed_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(__id, __text, __host, at, h, words) of every line with a word, written: texts are split into lines once."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), F.when(_has_word(x), line_hash(x)).alias("h"), F.size(native_words(x)).alias("words")))
    return scratch.table(docs.select("__id", "__text", "__host", F.explode(line).alias("l")).select("__id", "__text", "__host", "l.*").where("h IS NOT NULL"))


def frequent_lines(docs: DataFrame, lines: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS, spread: float = SPREAD, per: str = "documents") -> DataFrame:
    """(__host, h) of the lines above the limits. ``docs``: __id, __host, text, __text."""
    holder = F.struct(*PER[per])
    counts = lines.groupBy("__host", "h").agg(F.countDistinct(holder).alias("n"))
    hosts = docs.where("text IS NOT NULL").groupBy("__host").agg(F.countDistinct(holder).alias("docs"))
    return scratch.table(counts.where(F.col("n") > least_docs).join(hosts, "__host").where(F.col("n").cast("double") * F.col("n") > F.lit(spread) * F.col("docs")).select("__host", "h"))


def lost_lines(lines: DataFrame, frequent: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(__id, __text, at, n_removed_words) of the documents that hold frequent lines of their host, and a bound of their bytes."""
    frequent = broadcast_if_small(frequent, 64 * frequent.count())
    found = lines.join(frequent, ["__host", "h"]).select("__id", "__text", "at", "words").distinct()
    lost = scratch.table(found.groupBy("__id", "__text").agg(F.collect_set("at").alias("at"), F.sum("words").cast("long").alias("n_removed_words")))
    size = lost.agg(F.sum(F.size("at") * 4 + 64)).first()[0] or 0
    return lost.withColumnsRenamed({"__id": "__lost_id", "__text": "__lost_text"}), size


def _lost(docs: DataFrame, scratch: Scratch, least_docs: int, spread: float, per: str) -> tuple[DataFrame, int]:
    lines = hashed_lines(docs, scratch)
    lost = lost_lines(lines, frequent_lines(docs, lines, scratch, least_docs, spread, per), scratch)
    scratch.drop(lines)
    return lost


def _same(lost: DataFrame) -> Column:
    return F.col("__id").eqNullSafe(F.col("__lost_id")) & (F.col("__text") == F.col("__lost_text"))


def _kept(percent: int) -> Column:
    return ~F.col("base_failed") & (100 * (F.col("n_words") - F.coalesce("n_removed_words", F.lit(0))) >= percent * F.col("n_words"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = LEAST_DOCS, spread: float = SPREAD, kept_percent: int = KEPT_PERCENT, per: str = "documents") -> DataFrame:
    """One row per document: its id, the base counts, n_removed_words, base_failed, kept."""
    scratch, plain = Scratch(docs.sparkSession, "quality"), _plain(docs, id_col, text_col, host_col)
    lost, size = _lost(plain, scratch, least_docs, spread, per)
    metrics = base_metrics(plain, "__id", "__text").join(broadcast_if_small(lost, size), _same(lost), "left")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return metrics.select(F.col("__id").alias(id_col), *names, F.coalesce("n_removed_words", F.lit(0)).alias("n_removed_words"), "base_failed", _kept(kept_percent).alias("kept"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = LEAST_DOCS, spread: float = SPREAD, kept_percent: int = KEPT_PERCENT, per: str = "documents") -> DataFrame:
    """The kept rows of ``docs``, frequent lines removed from their text; other columns unchanged."""
    scratch, plain = Scratch(docs.sparkSession, "quality"), _plain(docs, id_col, text_col, host_col)
    lost, size = _lost(plain, scratch, least_docs, spread, per)
    row = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).withColumn("__text", F.xxhash64("text"))
    joined = base_metrics(row.select("__row", "__id", "__text", "text"), "__row", "__id", "__text").join(broadcast_if_small(lost, size), _same(lost), "left").where(_kept(kept_percent))
    left = F.array_join(F.filter(F.split(F.col(f"__row.{text_col}"), "\n"), lambda x, i: ~F.array_contains("at", i)), "\n")
    text = F.when(F.col("at").isNull(), F.col(f"__row.{text_col}")).otherwise(left)
    return joined.select(*(text.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
