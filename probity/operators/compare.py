"""Comparison of two audits of the same cases: what changed, by how much, and whether the change is certain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.operators.audit import RISKS, AuditConfig, lit
from probity.refusals import Refusal

STATUSES = ("regression", "improvement", "worsened", "improved", "unchanged")
METRICS = ("mean_gaming_gain", "worst_gaming_gain", "mean_degradation_drop", "weakest_degradation_drop", "mean_paraphrase_delta", "mean_validity_margin")
DEAD_BAND, SAME = 1e-9, 1e-12


def same_number(a: Column, b: Column) -> Column:
    """Equal up to an absolute 1e-12; null equals null only."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= SAME, F.lit(False))


def severity(delta: Column, kind: Column, cfg: AuditConfig) -> Column:
    """How far a variant is on the wrong side of its threshold; greater is worse."""
    return (
        F.when(kind == "gaming", delta - lit(cfg.gaming_tolerance))
        .when(kind == "degradation", delta + lit(cfg.min_degradation_drop))
        .otherwise(F.abs(delta) - lit(cfg.invariance_tolerance))
    )


def identity_differences(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(case_id, variant_id, missing_in) of the variants that only one side has."""
    keys = ["case_id", "variant_id"]
    r = reference.select(*keys, F.lit(True).alias("in_reference"))
    c = candidate.select(*keys, F.lit(True).alias("in_candidate"))
    joined = r.join(c, keys, "full_outer").where("in_reference is null or in_candidate is null")
    return joined.select(*keys, F.when(F.col("in_reference").isNull(), "reference").otherwise("candidate").alias("missing_in"))


def type_differences(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    r = reference.select("case_id", "variant_id", F.col("variant_type").alias("reference_type"))
    c = candidate.select("case_id", "variant_id", F.col("variant_type").alias("candidate_type"))
    return r.join(c, ["case_id", "variant_id"]).where("reference_type <> candidate_type")


def validate_same_variants(reference: DataFrame, candidate: DataFrame) -> None:
    """Refuse to compare audits of different variants; only the first offence reaches the driver."""
    first = identity_differences(reference, candidate).agg(F.min(F.struct("case_id", "variant_id", "missing_in"))).first()[0]
    if first is not None:
        raise Refusal(f"The audits must hold the same variants: {first['case_id']}/{first['variant_id']} is missing in the {first['missing_in']}.")
    first = type_differences(reference, candidate).agg(F.min(F.struct("case_id", "variant_id"))).first()[0]
    if first is not None:
        raise Refusal(f"The audits give {first['case_id']}/{first['variant_id']} different types.")


def findings(reference: DataFrame, candidate: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """One row per variant of both audits' findings: severity change, status, and whether it is provisional."""
    cfg = cfg or AuditConfig()
    fields = ["variant_type", "delta", "violated", "uncertain", "delta_standard_error"]
    keys = ["case_id", "variant_id"]
    r = reference.select(*keys, *(F.col(f).alias(f"reference_{f}") for f in fields))
    c = candidate.select(*keys, *(F.col(f).alias(f"candidate_{f}") for f in fields if f != "variant_type"))
    kind = F.col("reference_variant_type")
    joined = r.join(c, keys).withColumn("severity_change", severity(F.col("candidate_delta"), kind, cfg) - severity(F.col("reference_delta"), kind, cfg))
    was, now, change = F.col("reference_violated"), F.col("candidate_violated"), F.col("severity_change")
    status = F.when(~was & now, "regression").when(was & ~now, "improvement").when(change > DEAD_BAND, "worsened").when(change < -DEAD_BAND, "improved").otherwise("unchanged")
    provisional = F.col("reference_delta_standard_error").isNull() | F.col("candidate_delta_standard_error").isNull() | F.col("reference_uncertain") | F.col("candidate_uncertain")
    return joined.select(
        *keys, kind.alias("variant_type"), "reference_delta", "candidate_delta", "severity_change", "reference_violated", "candidate_violated",
        "reference_uncertain", "candidate_uncertain", provisional.alias("change_is_provisional"), status.alias("status"),
    )


def status_counts(compared: DataFrame) -> DataFrame:
    """(status, n) with a row for every status, also those that do not occur."""
    row = compared.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    return row.select(F.inline(F.array(*(F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATUSES))))


def side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One row from several tables of one row each, whose columns differ: a union and an aggregation, no join."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first.agg(*(F.max(c).alias(c) for c in first.columns))


def _prefixed(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in columns))


def metrics(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, reference, candidate, change) of two one-row summaries; null where either is."""
    both = side_by_side(_prefixed(reference, "reference_", METRICS), _prefixed(candidate, "candidate_", METRICS))
    r, c = (lambda m: F.col(f"reference_{m}")), (lambda m: F.col(f"candidate_{m}"))
    return both.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), r(m).alias("reference"), c(m).alias("candidate"), (c(m) - r(m)).alias("change")) for m in METRICS))))


def risk_rank(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(r) for r in RISKS)), level) - 1


def totals(reference: DataFrame, candidate: DataFrame, compared: DataFrame) -> DataFrame:
    """One row: risks, their ranks' change, rates, counts by status and the number of provisional changes."""
    counts = compared.agg(F.count("*").alias("variant_count"), *(F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES), F.count_if("change_is_provisional").alias("provisional_change_count"))
    shown = ("risk_level", "risk_is_provisional", "violation_rate", "uncertain_count")
    joined = side_by_side(counts, _prefixed(reference, "reference_", shown), _prefixed(candidate, "candidate_", shown))
    return joined.withColumns({
        "risk_rank_change": (risk_rank(F.col("candidate_risk_level")) - risk_rank(F.col("reference_risk_level"))).cast("int"),
        "violation_rate_change": F.col("candidate_violation_rate") - F.col("reference_violation_rate"),
    })


def self_consistency(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared counts of a summary against those of its findings: (field, declared, actual, agrees)."""
    actual = found.agg(
        F.count("*").cast("double").alias("variant_count"), F.count_if("violated").cast("double").alias("violation_count"), F.count_if("uncertain").cast("double").alias("uncertain_count"),
        F.try_divide(F.count_if("violated").cast("double"), F.count("*").cast("double")).alias("violation_rate"),
    )
    names = actual.columns
    both = side_by_side(_prefixed(actual, "actual_", names), declared.select(*(F.col(n).cast("double").alias(f"declared_{n}") for n in names)))
    d, made = (lambda n: F.col(f"declared_{n}")), (lambda n: F.col(f"actual_{n}"))
    rows = [F.struct(F.lit(n).alias("field"), d(n).alias("declared"), made(n).alias("actual"), same_number(d(n), made(n)).alias("agrees")) for n in names]
    return both.select(F.inline(F.array(*rows)))


def report_order(compared: DataFrame) -> DataFrame:
    """As reports list changes: by status, then the largest change, then the ids; a range-partitioned sort."""
    rank = F.array_position(F.array(*(F.lit(s) for s in STATUSES)), F.col("status")).cast("int")
    keyed = compared.withColumns({"status_rank": rank, "size": F.abs("severity_change")})
    return keyed.orderBy("status_rank", F.col("size").desc(), "case_id", "variant_id")
