"""Drafts of rewrites by a model, for people to approve: one per baseline, checked but never approved by a machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from time import perf_counter
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.functions import text as T
from probity.functions.fingerprint import stable_hash
from probity.functions.languages import CHINESE, Language


class Rewriter(Protocol):
    def complete(self, messages: list[dict[str, str]]) -> tuple[str, dict[str, Any]]: ...


def messages(text: str, language: Language) -> list[dict[str, str]]:
    """The request: an instruction and the text; no rubric, and no word on what the rewrite is for."""
    return [{"role": "system", "content": language.instruction}, {"role": "user", "content": text}]


def checked(pairs: DataFrame, language: Language = CHINESE) -> DataFrame:
    """Checks of drafts from (baseline_text, draft_text): blocking_checks, review_notes and status, all native.

    What the checks share is computed in steps, as columns, so that no lambda strips or searches a text again for each number.
    """
    stripped = pairs.withColumns({"__b": T.strip(F.col("baseline_text")), "__d": T.strip(F.col("draft_text"))})
    b, d = F.col("__b"), F.col("__d")
    counted = stripped.withColumns({"__gone": T.missing_numbers(b, d, language), "__before": T.negations(b, language), "__after": T.negations(d, language), "blocking_checks": T.blocking_checks(b, d)})
    notes = T.review_notes(d, F.col("__gone"), F.col("__before"), F.col("__after"))
    return counted.withColumns({"review_notes": notes, "status": T.review_status(F.col("blocking_checks"))}).drop("__b", "__d", "__gone", "__before", "__after")


def draft(cases: DataFrame, make_rewriter: Callable[[], Rewriter], language: Language = CHINESE) -> DataFrame:
    """One draft per baseline. A failing call fails the job and names its case; write only what a whole run gave."""
    schema = "ordinal long, case_id string, baseline_sha256 string, baseline_text string, raw_content string, latency_seconds double"

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewriter = make_rewriter()
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                began = perf_counter()
                try:
                    content, _ = rewriter.complete(messages(r.text, language))
                except Exception as error:
                    raise RuntimeError(f"Drafting failed on case {r.case_id!r}: {error}") from error
                rows.append((r.ordinal, r.case_id, stable_hash(r.text), r.text, content, perf_counter() - began))
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in schema.split(",")])

    made = cases.select(F.col("ordinal").cast("long"), "case_id", "text").mapInPandas(call, schema)
    return checked(made.withColumn("draft_text", T.strip(F.col("raw_content"))), language)
