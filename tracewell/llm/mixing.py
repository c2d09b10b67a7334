"""Operator 7, mixing by iterative proportional fitting. Built-in functions only.

Documents are counted into cells of source, language and topic, with their tokens (words). Every margin has a goal for
each of its values; a sweep scales the cells' probabilities so that the expected tokens meet the goals of every source,
then of every language, then of every topic. A document is taken if a uniform number made from its id is below its
cell's probability.

A budget, ``keep``, is the share of all tokens that the sample is to hold. A margin's goals are ``keep`` of all tokens by
its target shares; a value with fewer tokens than that gives all it has, and the others share the rest by their targets,
so one rare value doesn't set the rate of the whole. Probabilities never exceed 1. Without a budget (``keep=None``, the
default where targets are given) the goals are the target shares themselves and the weights that meet them are divided by
the largest: the highest rate at which the shares are exact.

Targets are given as tables of weights, or default to tempered shares: share ** power, normalised, which flattens a
dominant source or language. A value that isn't in a given table gets none.

Sweeps go on until at most ``SETTLED`` of the goal lies in wrong values, which also small steps reach in the end; they stop
earlier only if the error has not fallen by a tenth in ``PATIENCE`` rounds (goals that contradict each other, or cells that
are missing) or after ``MOST_ROUNDS``. ``Fit.residual`` is the error that is left, and more than ``MARGIN_ERROR`` is warned of.

The text is read once for the features; cells and margins are aggregated before each shuffle, so a source with a third
of all rows costs one partial sum for each task. A sweep is three windows over the cells, and each round of ``SWEEPS`` of
them is one job and one written table. The cells are broadcast to the documents if their counted size is small, else
joined (adaptive execution splits a hot cell).

Edge cases. Null source or language: a value of its own, ''. Null or empty text: 0 tokens, topic 'short'; such a
document has its cell's probability. A cell without tokens has its factors' product, at most 1. Repeated rows get the same
decision. Null ids count as ''. Extra columns are ignored by ``calibrated`` and kept by ``mix``. An empty table gives an
empty result.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.shared import Scratch, broadcast_if_small

#: Power of each margin's natural share in its target, and the share of tokens to keep.
TEMPER, KEEP, SEED = {"source": 0.8, "lang": 0.8, "topic": 0.9}, 0.5, "mix-1"
#: Sweeps of a round, the error at which rounds end, rounds without a tenth less of it, rounds at most, the error that is warned of.
SWEEPS, SETTLED, PATIENCE, MOST_ROUNDS, MARGIN_ERROR = 8, 1e-10, 10, 100, 1e-3


def topic_of(text: Column) -> Column:
    """A topic by what a text is used for, else by its length: contact, legal, long, medium or short."""
    n = F.length(text)
    return F.when(F.contains(text, F.lit("@")), "contact").when(F.regexp_like(text, F.lit("(?i)licen[sc]e|rights reserved")), "legal").when(n >= 4000, "long").when(n >= 800, "medium").otherwise("short")


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1 made from an id: the first 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def features(docs: DataFrame, *keep: Column | str, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, tokens_col: str | None = None) -> DataFrame:
    """The columns ``keep`` and source, lang, topic, n_tokens of each row.

    Topics and token counts that are known (from a classifier, a tokenizer) are taken from the named columns.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(*keep, known(source_col).alias("source"), known(lang_col).alias("lang"), (known(topic_col) if topic_col else topic_of(text)).alias("topic"), (F.coalesce(F.col(tokens_col), F.lit(0)) if tokens_col else F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))).cast("long").alias("n_tokens"))


@dataclass
class Fit:
    """(source, lang, topic, tokens, probability) of each cell, how many there are, and the share of tokens in wrong values."""

    cells: DataFrame
    n: int
    residual: float


def _shares(values: DataFrame, d: str, power: float, table: DataFrame | None) -> DataFrame:
    """``values`` (d, has) with t: target weights that are given, or tempered ones; a value without tokens has none."""
    if table is None:
        return values.withColumn("t", F.pow(F.col("has").cast("double"), F.lit(power)))
    given = table.select(F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d), F.col("weight").cast("double").alias("t")).groupBy(d).agg(F.sum("t").alias("t"))
    return values.join(given, d, "left").withColumn("t", F.when(F.col("has") > 0, F.coalesce("t", F.lit(0.0))).otherwise(0.0))


def _goals(values: DataFrame, goal: float, capped: bool) -> DataFrame:
    """(d, goal) of each value: ``goal`` tokens by target weight; ``capped``: no value more than it has."""
    full, free = 0, values.agg(F.sum("t")).first()[0]
    while True:  # each round but the last fills one more value
        scale = (goal - full) / free if free else 0.0
        whole = F.lit(scale) * F.col("t") >= F.col("has") if capped else F.lit(False)
        now, free = values.agg(F.coalesce(F.sum(F.when(whole, F.col("has"))), F.lit(0)), F.coalesce(F.sum(F.when(~whole, F.col("t"))), F.lit(0.0))).first()
        if now == full:
            wanted = F.lit(scale) * F.col("t")
            return values.withColumn("goal", F.least(F.col("has").cast("double"), wanted) if capped else wanted).drop("has", "t")
        full = now


def _off(cells: DataFrame, margins: tuple[str, ...], goal: float) -> float:
    """The largest share of the goal, over the margins, that lies in wrong values."""
    worst = 0.0
    for d in margins:
        held = cells.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("held"), F.first(f"goal_{d}").alias("goal"))
        total, off = held.agg(F.sum("held"), F.sum(F.abs(F.col("held") - F.col("goal")))).first()
        worst = max(worst, (off or 0.0) / 2 / goal, abs((total or 0.0) - goal) / goal)
    return worst


def raked(rows: DataFrame, scratch: Scratch, temper: dict[str, float] = TEMPER, keep: float | None = KEEP, targets: dict[str, DataFrame] | None = None) -> Fit:
    """The fitted cells of ``rows`` (the margins' columns and n_tokens)."""
    margins, targets = tuple(temper), targets or {}
    cells = scratch.table(rows.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens")))
    n, total = cells.agg(F.count("*"), F.sum("tokens")).first()
    if not total:
        return Fit(cells.withColumn("probability", F.lit(1.0)), n, 0.0)
    goal, now = (total if keep is None else keep * total), cells
    for d, power in temper.items():
        values = scratch.table(_shares(cells.groupBy(d).agg(F.sum("tokens").alias("has")), d, power, targets.get(d)))
        now = now.join(_goals(values, goal, keep is not None).withColumnRenamed("goal", f"goal_{d}"), d)
    now, errors = now.withColumn("weight", F.lit(1.0)), []
    while True:
        for _ in range(SWEEPS):
            for d in margins:
                held = F.sum(F.col("tokens") * F.col("weight")).over(W.partitionBy(d))
                scaled = F.when(held > 0, F.col("weight") * F.col(f"goal_{d}") / held).otherwise(F.col("weight"))
                now = now.withColumn("weight", scaled if keep is None else F.least(F.lit(1.0), scaled))
        now = scratch.table(now)
        errors.append(_off(now, margins, goal))
        if errors[-1] <= SETTLED or len(errors) >= MOST_ROUNDS or len(errors) > PATIENCE and errors[-1] > 0.9 * errors[-1 - PATIENCE]:
            break
    most = now.where("tokens > 0").agg(F.max("weight")).first()[0]
    if errors[-1] > MARGIN_ERROR:
        warnings.warn(f"{errors[-1]:.2g} of the tokens are in values that the targets give to others", stacklevel=2)
    probability = F.col("weight") if keep is not None else F.least(F.lit(1.0), F.col("weight") / F.lit(most or 1.0))
    return Fit(now.select(*margins, "tokens", probability.alias("probability")), n, errors[-1])


def _rates(rows: DataFrame, scratch: Scratch, temper: dict[str, float], keep: float | None, targets: dict[str, DataFrame] | None) -> DataFrame:
    fit = raked(rows, scratch, temper, None if targets and keep == KEEP else keep, targets)
    return broadcast_if_small(fit.cells.select(*temper, "probability"), 200 * (fit.n + 1))


def calibrated(docs: DataFrame, id_col: str = "doc_id", temper: dict[str, float] = TEMPER, keep: float | None = KEEP, seed: str = SEED, targets: dict[str, DataFrame] | None = None, **columns: str) -> DataFrame:
    """One row per document: its id, source, lang, topic, n_tokens, probability, kept. ``columns``: as for ``features``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.table(features(docs, F.col(id_col).alias("__id"), **columns))
    out = rows.join(_rates(rows, scratch, temper, keep, targets), list(temper))
    return out.select(F.col("__id").alias(id_col), "source", "lang", "topic", "n_tokens", "probability", (uniform(F.col("__id"), seed) < F.col("probability")).alias("kept"))


def mix(docs: DataFrame, id_col: str = "doc_id", temper: dict[str, float] = TEMPER, keep: float | None = KEEP, seed: str = SEED, targets: dict[str, DataFrame] | None = None, **columns: str) -> DataFrame:
    """The rows of ``docs`` that are taken."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rates = _rates(features(docs, **columns), scratch, temper, keep, targets)
    rows = features(docs.withColumn("__row", F.struct("*")), "__row", **columns)
    taken = rows.join(rates, list(temper)).where(uniform(F.col(f"__row.`{id_col}`"), seed) < F.col("probability"))
    return taken.select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
