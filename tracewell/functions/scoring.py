"""Cleaning, decisions and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "__missing__"


#: Unicode's white space, and the four separators of ASCII.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(token: Column) -> Column:
    """Without white space of any kind at both ends. Only the ends are looked at, so long tokens cost no more."""
    return F.btrim(token, F.lit(WHITE))


def clean(token: Column) -> Column:
    """A raw field: stripped, with '' and '?' as null."""
    return F.nullif(F.nullif(strip(token), F.lit("")), F.lit("?"))


def income_label(token: Column) -> Column:
    """1 for '>50K' with any number of final stops, else 0."""
    return F.when(F.regexp_replace(strip(token), "\\.+$", "") == ">50K", 1).otherwise(0)


def decision(score: Column, threshold: Column | float) -> Column:
    return F.when(score >= threshold, "approve").otherwise("deny")


def group_of(c: Column) -> Column:
    """A sensitive value; a missing one is a group of its own."""
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def binary(c: Column, what: str) -> Column:
    """The value if it is 0 or 1; anything else, a probability say, fails the job."""
    return F.when(c.isin(0, 1), c.cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"{what} must be 0 or 1, not "), F.coalesce(c.cast("string"), F.lit("null")))))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.ln(q / (1 - q))


def link_of(explainer_type: Column, estimator_class: Column) -> Column:
    """'identity' where attributions add up to a probability, 'logit' where they add up to log-odds.

    Fixed values: the recorded class names of tree estimators, which decisions that were made elsewhere may carry.
    """
    return F.when((explainer_type != "linear") & estimator_class.rlike("^sklearn\\.(ensemble|tree)"), "identity").otherwise("logit")


def expected_total(link: Column, score: Column) -> Column:
    return F.when(link == "logit", logit(score)).otherwise(score)


def direction(value: Column) -> Column:
    return F.when(value > 0, "toward approval").otherwise("toward denial")


def statement(source: Column, category: Column, value: Column) -> Column:
    """What an encoded column says of its subject (fixed forms): 'age = 39', 'sex = Male', 'sex is not Female'."""
    word = F.when(category.isNull() | (category == value), " = ").otherwise(" is not ")
    return F.concat(source, word, F.coalesce(category, value, F.lit("null")))


def unknown_features(payload: Column, known: list[str]) -> Column:
    """Keys of a JSON payload that no model input has."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), F.array(*map(F.lit, known))))


def canonical_payload(payload: Column) -> Column:
    """A flat JSON payload with its keys sorted, so that equal inputs have equal text."""
    m = F.from_json(payload, "map<string,string>")
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))), {"ignoreNullFields": "false"})
