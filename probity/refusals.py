"""Refusals: malformed or contradictory input stops a run, with the first offence named."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refusal(ValueError):
    """Input that must not be dropped, coerced or guessed at."""


@dataclass(frozen=True)
class Rule:
    """A broken rule: its id, when it is broken, and the message as a column."""

    rule_id: str
    broken: Column
    message: Column


def violations(df: DataFrame, rules: Sequence[Rule], order: str = "ordinal") -> DataFrame:
    """(ordinal, rule_no, rule_id, message) of every broken rule of every row: one narrow pass."""
    found = [
        F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.col(order).cast("long").alias("ordinal"), F.lit(n).alias("rule_no"), F.lit(r.rule_id).alias("rule_id"), r.message.alias("message")))
        for n, r in enumerate(rules)
    ]
    return df.select(F.inline(F.array_compact(F.array(*found))))


def refuse_first(found: DataFrame) -> None:
    """Raise the first offence by row, then rule; only that one row reaches the driver."""
    first = found.agg(F.min(F.struct("ordinal", "rule_no", "rule_id", "message")).alias("first")).first()["first"]
    if first is not None:
        raise Refusal(first["message"])


def check(df: DataFrame, rules: Sequence[Rule], order: str = "ordinal") -> DataFrame:
    """``df`` if no rule is broken, else the first offence is raised."""
    refuse_first(violations(df, rules, order))
    return df
