"""The audit: verdicts per variant, margins per case, and one summary with a risk level.

Every operator takes and returns a DataFrame and is lazy. Scores are shuffled once on the case: the baseline of a case is one row, so
its join may be split where one case is very large, and everything after it is partial aggregation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.refusals import Refusal, Rule, check, refuse_first

# The domains, and the two-sided 95 % points of Student's t for 1 to 30 degrees of freedom.
VARIANT_TYPES = ("baseline", "gaming", "degradation", "paraphrase")
PROVENANCES = ("synthetic", "public-demo", "authorized-private", "unspecified")
ORIGINS = ("human-authored", "machine-generated", "mixed", "unspecified")
T_CRITICAL = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class AuditConfig:
    """Thresholds and declarations of an audit."""

    invariance_tolerance: float = 0.5
    min_degradation_drop: float = 1.0
    gaming_tolerance: float = 0.0
    score_min: float | None = None
    score_max: float | None = None
    data_provenance: str = "unspecified"
    variant_origin: str = "unspecified"

    def validate(self) -> AuditConfig:
        for name in ("invariance_tolerance", "min_degradation_drop", "gaming_tolerance"):
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) >= 0):
                raise Refusal(f"{name} must be finite and not negative.")
        ends = (self.score_min, self.score_max)
        if ends.count(None) == 1:
            raise Refusal("score_min and score_max belong together: give both or neither.")
        if None not in ends:
            if not all(map(math.isfinite, ends)):
                raise Refusal("score_min and score_max must be finite.")
            if ends[0] >= ends[1]:
                raise Refusal("score_max must be greater than score_min.")
        if self.data_provenance not in PROVENANCES:
            raise Refusal(f"data_provenance must be one of {', '.join(PROVENANCES)}.")
        if self.variant_origin not in ORIGINS:
            raise Refusal(f"variant_origin must be one of {', '.join(ORIGINS)}.")
        return self

    @property
    def has_scale(self) -> bool:
        return self.score_min is not None


def lit(value: float | None) -> Column:
    """A double: a bare literal of Python would do, but a decimal one would change the arithmetic."""
    return F.lit(value).cast("double")


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))


def row_rules(cfg: AuditConfig) -> list[Rule]:
    """What each score row must satisfy before anything is compared."""
    score, stddev, count = F.col("score"), F.col("score_stddev"), F.col("sample_count")
    name = F.concat_ws("/", "case_id", "variant_id")

    def text(before: str, after: str) -> Column:
        return F.concat(F.lit(before), name, F.lit(after))

    rules = [
        Rule("type", ~F.coalesce(F.col("variant_type").isin(*VARIANT_TYPES), F.lit(False)), text("", ": the variant type is not one of " + ", ".join(VARIANT_TYPES) + ".")),
        Rule("score_finite", ~finite(score), text("The score of ", " must be a finite number.")),
        Rule("count_positive", F.coalesce(count, F.lit(0)) < 1, text("sample_count of ", " must be at least 1.")),
        Rule("stddev_finite", stddev.isNotNull() & (~finite(stddev) | (stddev < 0)), text("score_stddev of ", " must be finite and not negative.")),
        Rule("stddev_missing", (count > 1) & stddev.isNull(), text("score_stddev is missing for the repeated score of ", ".")),
        Rule("stddev_single", (count == 1) & stddev.isNotNull() & (stddev != 0), text("score_stddev of the single score ", " must be empty or 0.")),
    ]
    if cfg.has_scale:
        rules.append(Rule("range", ~score.between(cfg.score_min, cfg.score_max), F.concat(F.lit("The score "), score.cast("string"), F.lit(" of "), name, F.lit(f" lies outside [{cfg.score_min}, {cfg.score_max}]."))))
    return rules


def pairing(scores: DataFrame) -> DataFrame:
    """Per case: how many baselines it has, and whether gaming and degradation variants are there."""
    kind = F.col("variant_type")
    return scores.groupBy("case_id").agg(
        F.count_if(kind == "baseline").alias("baselines"),
        F.coalesce(F.max(kind == "gaming"), F.lit(False)).alias("has_gaming"),
        F.coalesce(F.max(kind == "degradation"), F.lit(False)).alias("has_degradation"),
    )


def duplicate_keys(scores: DataFrame) -> DataFrame:
    """(case_id, variant_id, n) of the keys that occur more than once."""
    return scores.groupBy("case_id", "variant_id").agg(F.count("*").alias("n")).where("n > 1")


def validate(scores: DataFrame, cfg: AuditConfig) -> DataFrame:
    """Refuse what must not be audited: row rules first, then keys and pairing. Separate actions, before any write."""
    cfg.validate()
    system = F.col("system_name") if "system_name" in scores.columns else F.lit("")
    row = scores.agg(F.count("*").alias("n"), F.min(system).alias("first"), F.max(system).alias("last")).first()
    if not row["n"]:
        raise Refusal("At least one score record is required.")
    if row["first"] != row["last"]:
        raise Refusal(f"An audit covers exactly one system_name; found at least {row['first']!r} and {row['last']!r}.")
    numbered = scores if "ordinal" in scores.columns else scores.withColumn("ordinal", F.monotonically_increasing_id())
    check(numbered, row_rules(cfg))
    twice = duplicate_keys(scores).agg(F.min(F.struct("case_id", "variant_id"))).first()[0]
    if twice is not None:
        raise Refusal(f"Case {twice['case_id']!r} holds variant_id {twice['variant_id']!r} more than once.")
    case = F.col("case_id")
    lacks = F.concat_ws(", ", F.when(~F.col("has_degradation"), F.lit("degradation")), F.when(~F.col("has_gaming"), F.lit("gaming")))
    rules = [
        Rule("baseline", F.col("baselines") != 1, F.concat(F.lit("Case '"), case, F.lit("' must have exactly one baseline; found "), F.col("baselines").cast("string"), F.lit("."))),
        Rule("paired", ~F.col("has_gaming") | ~F.col("has_degradation"), F.concat(F.lit("Case '"), case, F.lit("' lacks paired variants: "), lacks, F.lit("."))),
    ]
    broken = [F.when(F.coalesce(r.broken, F.lit(False)), F.struct(case.alias("ordinal"), F.lit(n).alias("rule_no"), F.lit(r.rule_id).alias("rule_id"), r.message.alias("message"))) for n, r in enumerate(rules)]
    refuse_first(pairing(scores).select(F.inline(F.array_compact(F.array(*broken)))))
    return scores


def findings(scores: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """One row per variant: its baseline, delta, verdict, standard error and whether the verdict is uncertain."""
    cfg = cfg or AuditConfig()
    is_base = F.col("variant_type") == "baseline"
    base = scores.where(is_base).select(
        "case_id", F.col("score").alias("baseline_score"), F.col("score_stddev").alias("baseline_score_stddev"), F.col("sample_count").alias("baseline_sample_count")
    )
    joined = scores.where(~is_base).join(base, "case_id")
    b, v = F.col("baseline_score"), F.col("score")
    kind = F.col("variant_type")
    contrast = (
        F.when(kind == "gaming", (v - b) - lit(cfg.gaming_tolerance))
        .when(kind == "degradation", (b - v) - lit(cfg.min_degradation_drop))
        .otherwise(F.abs(v - b) - lit(cfg.invariance_tolerance))
    )
    known = (F.col("baseline_sample_count") > 1) & (F.col("sample_count") > 1) & F.col("baseline_score_stddev").isNotNull() & F.col("score_stddev").isNotNull()
    variance = F.col("baseline_score_stddev") * F.col("baseline_score_stddev") / F.col("baseline_sample_count") + F.col("score_stddev") * F.col("score_stddev") / F.col("sample_count")
    degrees = F.least(F.col("baseline_sample_count"), F.col("sample_count")).cast("int") - 1
    table = F.array(*map(lit, T_CRITICAL))
    critical = F.when(degrees >= 1, F.element_at(table, F.greatest(F.lit(1), F.least(degrees, F.lit(len(T_CRITICAL))))))
    error = F.when(known, F.sqrt(variance))
    return joined.withColumns({"delta": v - b, "contrast": contrast, "delta_standard_error": error}).select(
        *(["ordinal"] if "ordinal" in scores.columns else []), "case_id", "variant_id", "variant_type", "baseline_score", F.col("score").alias("variant_score"), "delta",
        F.when(kind == "degradation", F.col("contrast") < 0).otherwise(F.col("contrast") > 0).alias("violated"),
        F.coalesce((F.col("delta_standard_error") > 0) & (F.abs("contrast") <= critical * F.col("delta_standard_error")), F.lit(False)).alias("uncertain"),
        "delta_standard_error", F.col("score_stddev").alias("variant_score_stddev"), F.col("sample_count").alias("variant_sample_count"),
        "baseline_score_stddev", "baseline_sample_count",
    )


def _gain() -> Column:
    return F.when(F.col("variant_type") == "gaming", F.col("delta"))


def _drop() -> Column:
    return F.when(F.col("variant_type") == "degradation", F.col("baseline_score") - F.col("variant_score"))


def _change() -> Column:
    return F.when(F.col("variant_type") == "paraphrase", F.abs("delta"))


def case_figures(found: DataFrame) -> DataFrame:
    """Per case: its margin (mean drop less the rewarded gain), and sums from which the summary follows without the findings."""
    return found.groupBy("case_id").agg(
        F.first("baseline_score").alias("baseline_score"),
        (F.avg(_drop()) - F.greatest(lit(0.0), F.max(_gain()))).alias("validity_margin"),
        F.count("*").alias("variants"), F.count_if("violated").alias("violations"), F.count_if("uncertain").alias("uncertain"), F.count("delta_standard_error").alias("evaluable"),
        F.sum(_gain()).alias("gain_sum"), F.count(_gain()).alias("gains"), F.max(_gain()).alias("gain_max"),
        F.sum(_drop()).alias("drop_sum"), F.count(_drop()).alias("drops"), F.min(_drop()).alias("drop_min"),
        F.sum(_change()).alias("change_sum"), F.count(_change()).alias("changes"),
    )


def case_margins(found: DataFrame) -> DataFrame:
    return case_figures(found).select("case_id", "baseline_score", "validity_margin")


def headroom(cases: DataFrame, cfg: AuditConfig) -> DataFrame:
    """How many baselines lie closer to an end of the scale than the drop that counts; null without a scale."""
    if not cfg.has_scale:
        return cases.agg(F.count("*").alias("case_count")).select("case_count", F.lit(None).cast("long").alias("ceiling_limited_count"), F.lit(None).cast("long").alias("floor_limited_count"))
    base, least = F.col("baseline_score"), lit(cfg.min_degradation_drop)
    return cases.agg(
        F.count("*").alias("case_count"),
        F.count_if(lit(cfg.score_max) - base < least).alias("ceiling_limited_count"),
        F.count_if(base - lit(cfg.score_min) < least).alias("floor_limited_count"),
    )


def risk_level(cfg: AuditConfig) -> Column:
    """The ladder over a summary row. Without a scale the critical changes are absolute."""
    span = cfg.score_max - cfg.score_min if cfg.has_scale else None
    gain, reversal = (span * 0.20, -(span * 0.10)) if span is not None else (2.0, -1.0)
    critical = F.coalesce(F.col("worst_gaming_gain") >= gain, F.lit(False)) | F.coalesce(F.col("weakest_degradation_drop") <= reversal, F.lit(False))
    high = (F.col("violation_rate") >= 0.5) | F.coalesce(F.col("mean_validity_margin") <= 0.0, F.lit(False))
    return F.when(critical, "CRITICAL").when(high, "HIGH").when(F.col("violation_rate") >= 0.25, "MEDIUM").otherwise("LOW")


def evidence_grade(cases: Column) -> Column:
    """How much a number of cases can show."""
    return F.when(cases < 5, "anecdotal").when(cases < 30, "limited").otherwise("substantial")


def summary(found: DataFrame, cfg: AuditConfig | None = None) -> DataFrame:
    """One row: counts, rates, means, worst values, headroom and the risk level. Two levels of aggregation, one shuffle."""
    cfg = cfg or AuditConfig()
    base, least = F.col("baseline_score"), lit(cfg.min_degradation_drop)
    scale = cfg.has_scale
    row = case_figures(found).agg(
        F.count("*").alias("case_count"), F.sum("variants").alias("variant_count"), F.sum("violations").alias("violation_count"),
        F.try_divide(F.sum("violations").cast("double"), F.sum("variants").cast("double")).alias("violation_rate"),
        F.sum("evaluable").alias("uncertainty_evaluable_count"), F.sum("uncertain").alias("uncertain_count"),
        F.try_divide(F.sum("gain_sum"), F.sum("gains").cast("double")).alias("mean_gaming_gain"), F.max("gain_max").alias("worst_gaming_gain"),
        F.try_divide(F.sum("drop_sum"), F.sum("drops").cast("double")).alias("mean_degradation_drop"), F.min("drop_min").alias("weakest_degradation_drop"),
        F.try_divide(F.sum("change_sum"), F.sum("changes").cast("double")).alias("mean_paraphrase_delta"), F.avg("validity_margin").alias("mean_validity_margin"),
        (F.count_if(lit(cfg.score_max) - base < least) if scale else F.lit(None).cast("long")).alias("ceiling_limited_count"),
        (F.count_if(base - lit(cfg.score_min) < least) if scale else F.lit(None).cast("long")).alias("floor_limited_count"),
    )
    return row.withColumns({
        "risk_is_provisional": (F.col("uncertainty_evaluable_count") < F.col("variant_count")) | (F.col("uncertain_count") > 0),
        "risk_level": risk_level(cfg),
        "evidence_grade": evidence_grade(F.col("case_count")),
    })


def nested_cases(found: DataFrame) -> DataFrame:
    """Per case its variants as an array in input order: only where nested output is asked for."""
    order = "ordinal" if "ordinal" in found.columns else "variant_id"
    fields = ["variant_id", "variant_type", "variant_score", "delta", "violated", "uncertain", "delta_standard_error", "variant_score_stddev", "variant_sample_count"]
    entry = F.struct(F.col(order).alias("at"), *fields)
    margin = F.avg(_drop()) - F.greatest(lit(0.0), F.max(_gain()))
    grouped = found.groupBy("case_id").agg(
        F.first("baseline_score").alias("baseline_score"), F.first("baseline_score_stddev").alias("baseline_score_stddev"), F.first("baseline_sample_count").alias("baseline_sample_count"),
        F.array_sort(F.collect_list(entry)).alias("sorted"), margin.alias("validity_margin"),
    )
    return grouped.withColumn("variants", F.transform("sorted", lambda x: F.struct(*(x[f].alias(f) for f in fields)))).drop("sorted")


def strategy_means(found: DataFrame) -> DataFrame:
    """Mean delta, and verdicts, per variant id over all cases."""
    return found.groupBy("variant_id", "variant_type").agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.count_if("violated").alias("violations"))
