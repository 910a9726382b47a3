"""Named queries of the audit engine over the driver's tables, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.functions import text as T
from probity.functions.fingerprint import CASE_FIELDS, row_fingerprint, text_hash
from probity.functions.languages import CHINESE, ENGLISH
from probity.operators import audit, compare, paraphrase, scoring, trajectory, variants
from probity.plans import adapters as A
from probity.plans import oracle
from probity.refusals import violations
from probity.session import kept
from probity.sources import csv_tables, trajectories
from probity.sources.tables import numbered

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = audit.AuditConfig()
SCALED = audit.AuditConfig(score_min=0.0, score_max=10.0)
#: A range that some scores break, so that the query of violations has rows.
NARROW = audit.AuditConfig(score_min=1.0, score_max=9.0)
RESUMED, REPEATS, SEED = 2, 5, 7
ROUND = 9


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums depend on the order of addition in their last digits: compare the first nine decimals, and no negative zero."""
    return df.withColumns({c: F.round(c, ROUND) + F.lit(0.0) for c in columns})


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.findings(A.scores(spark, sf_dir), CONFIG)


def _candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.findings(A.candidate_scores(spark, sf_dir), CONFIG)


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_findings(spark, sf_dir).drop("ordinal"), "delta_standard_error")


def audit_case_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.case_margins(_findings(spark, sf_dir)), "validity_margin")


MEANS = ("violation_rate", "mean_gaming_gain", "mean_degradation_drop", "mean_paraphrase_delta", "mean_validity_margin")


def _summary(spark: SparkSession, sf_dir: str, cfg: audit.AuditConfig) -> DataFrame:
    return audit.summary(audit.findings(A.scores(spark, sf_dir), cfg), cfg)


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_summary(spark, sf_dir, CONFIG).drop("ceiling_limited_count", "floor_limited_count"), *MEANS)


def audit_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder with absolute and with scale-relative cut-offs."""
    rows = [_summary(spark, sf_dir, cfg).select(F.lit(name).alias("scale"), "risk_level", "risk_is_provisional") for name, cfg in (("none", CONFIG), ("0-10", SCALED))]
    return rows[0].unionByName(rows[1])


def audit_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.headroom(audit.case_margins(_findings(spark, sf_dir)), SCALED)


def audit_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _findings(spark, sf_dir).groupBy("variant_type").agg(F.count("*").alias("variants"), F.count("delta_standard_error").alias("evaluable"), F.count_if("uncertain").alias("uncertain"), F.avg("delta_standard_error").alias("mean_standard_error"))
    return rounded(found, "mean_standard_error")


def audit_nested_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = audit.nested_cases(_findings(spark, sf_dir))
    worst = F.aggregate("variants", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v["delta"])))
    flat = nested.select("case_id", "baseline_score", "validity_margin", F.size("variants").alias("n"), F.array_join(F.transform("variants", lambda v: v["variant_id"]), ",").alias("variant_ids"), worst.alias("largest_change"))
    return rounded(flat, "validity_margin", "largest_change")


def evidence_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, CONFIG).select("case_count", "evidence_grade")


def strategy_mean_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.strategy_means(_findings(spark, sf_dir)), "mean_delta")


def score_row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = A.scores(spark, sf_dir).withColumn("score_stddev", F.when(F.col("sample_count") != 5, F.col("score_stddev")))
    return violations(scores, audit.row_rules(NARROW)).groupBy("rule_id").agg(F.count("*").alias("n"))


def pairing_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = A.scores(spark, sf_dir).where("not (variant_id = 'v3' and sample_count >= 5)")
    return audit.pairing(kept).where("baselines <> 1 or not has_gaming or not has_degradation")


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = A.scores(spark, sf_dir).withColumn("variant_id", F.concat(F.lit("n"), F.col("sample_count").cast("string")))
    return audit.duplicate_keys(scores)


def compare_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.findings(_findings(spark, sf_dir), _candidate(spark, sf_dir), CONFIG), "severity_change", "reference_delta", "candidate_delta")


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.findings(_findings(spark, sf_dir), _candidate(spark, sf_dir), CONFIG)


def compare_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.status_counts(_compared(spark, sf_dir))


def compare_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.metrics(audit.summary(_findings(spark, sf_dir), CONFIG), audit.summary(_candidate(spark, sf_dir), CONFIG))
    return rounded(found, "reference", "candidate", "change")


def compare_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, candidate = kept(_findings(spark, sf_dir)), kept(_candidate(spark, sf_dir))  # each is used twice
    found = compare.totals(audit.summary(reference, CONFIG), audit.summary(candidate, CONFIG), compare.findings(reference, candidate, CONFIG))
    return rounded(found, "reference_violation_rate", "candidate_violation_rate", "violation_rate_change")


def compare_identity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = _findings(spark, sf_dir).where("variant_sample_count <> 7")
    return compare.identity_differences(reference, _candidate(spark, sf_dir).where("variant_id <> 'v7'"))


def compare_self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept(_findings(spark, sf_dir))  # used twice
    return rounded(compare.self_consistency(found, audit.summary(found, CONFIG)), "declared", "actual")


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order itself is compared, as a number for each row."""
    ordered = kept(compare.report_order(_compared(spark, sf_dir)).select("case_id", "variant_id", "status", "status_rank", "size"))
    return rounded(numbered(ordered, "position"), "size")


def repeat_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.aggregate(A.samples(spark, sf_dir)), "score", "score_stddev")


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.token_totals(A.samples(spark, sf_dir))


def latency_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first samples of each variant as resumed ones."""
    found = scoring.latency_totals(A.samples(spark, sf_dir).withColumn("resumed", F.col("sample_index") <= RESUMED))
    return rounded(found, "total_sample_latency_seconds", "new_sample_latency_seconds")


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.plan(A.scored_cases(spark, sf_dir), REPEATS)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.samples(spark, sf_dir)


def resume_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.missing(_planned(spark, sf_dir), _state(spark, sf_dir)).select(*scoring.SAMPLE_KEY)


def resume_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.foreign(_planned(spark, sf_dir), _state(spark, sf_dir)).select(*scoring.SAMPLE_KEY)


def resume_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.mismatched(_planned(spark, sf_dir), _state(spark, sf_dir))


def planned_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = A.baselines(spark, sf_dir).select("case_id", F.lit("baseline").alias("variant_id"), F.lit("baseline").alias("variant_type"), "text")
    return scoring.plan(cases, 3).select("case_id", "variant_id", "sample_index", "input_sha256")


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by their marks alone, which a regular expression states; numbered from 1."""
    docs = A.baselines(spark, sf_dir)
    return docs.select("case_id", F.posexplode(T.sentences(F.col("text"), A.PLAIN)).alias("at", "sentence")).select("case_id", (F.col("at") + 1).cast("long").alias("number"), "sentence")


def sentence_split_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with the guards around full stops; numbered from 1."""
    docs = A.baselines(spark, sf_dir)
    return docs.select("case_id", F.posexplode(T.sentences(F.col("text"), ENGLISH)).alias("at", "sentence")).select("case_id", (F.col("at") + 1).cast("long").alias("number"), "sentence")


def _split_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines with their sentences; the evidence is the second one, or the only one."""
    cases = A.baselines(spark, sf_dir).withColumn("sentences", T.sentences(F.col("text"), A.PLAIN))
    last = F.least(F.size("sentences"), F.lit(2)).cast("long")
    return cases.withColumn("evidence_sentences", F.when(last > 0, F.array(last)).otherwise(F.array().cast("array<bigint>")))


def _variant(strategy: str, language=ENGLISH) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return variants.variant(_split_baselines(spark, sf_dir), strategy, language, seed=SEED).select("case_id", "variant_id", "variant_type", "text", "notes", "problem")

    return query


def connective_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectives set at the front of the sentences of documents, and replaced."""
    start = F.when(F.col("ordinal") % 3 == 0, "However, ").when(F.col("ordinal") % 3 == 1, "finally it was. In addition ").otherwise("")
    cases = _split_baselines(spark, sf_dir).withColumn("text", F.concat(start, F.col("text")))
    return variants.variant(cases, "connective_substitution", ENGLISH).select("case_id", "text", "notes", "problem")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants.variant(_split_baselines(spark, sf_dir), "rubric_flattery", ENGLISH)
    return rows.withColumn("row_order", F.col("ordinal"))


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file as people left it: texts with numbers removed from it, those with exclamation marks edited, those that begin with T renamed."""
    kept = _generated(spark, sf_dir).where("not text rlike '[0-9]'")
    edited = kept.withColumn("text", F.when(F.contains("text", F.lit("!")), F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    return edited.withColumn("variant_id", F.when(F.startswith("text", F.lit("T")), "by_hand").otherwise(F.col("variant_id")))


def merge_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.merge(_generated(spark, sf_dir), _existing(spark, sf_dir)).select("case_id", "variant_id", "merge_class", "text")


def merge_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.merge_origin(variants.merge(_generated(spark, sf_dir), _existing(spark, sf_dir)))


def review_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paraphrase.checked(A.drafts(spark, sf_dir), ENGLISH)
    return found.select("case_id", F.array_join("blocking_checks", "; ").alias("blocking_checks"), F.array_join("review_notes", "; ").alias("review_notes"), "status")


def review_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.review_tally(paraphrase.checked(A.drafts(spark, sf_dir), ENGLISH))


def ratified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that nothing blocks as approved rewrites of all documents; texts that were stripped since are edited ones."""
    review = paraphrase.checked(A.drafts(spark, sf_dir), ENGLISH).where("status = 'pending'")
    ordinal = F.col("case_id").cast("long")
    decided = review.select(ordinal.alias("ordinal"), "case_id", text_hash(F.col("baseline_text")).alias("baseline_sha256"), "draft_text", F.lit("approved").alias("status"), F.when(ordinal % 2 == 0, "read").otherwise("").alias("reviewer_note"))
    return variants.ratified(decided, A.baselines(spark, sf_dir)).select("case_id", "variant_id", "variant_type", "text", "notes", "problem")


def traj_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = A.trajectories(spark, sf_dir)
    return cases.select("case_id", trajectory.render(F.col("steps"), F.col("task"), F.col("final_answer"), ENGLISH).alias("text"))


def _trajectory(strategy: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = trajectory.variant(A.trajectories(spark, sf_dir), strategy, ENGLISH, seed=SEED)
        listed = F.array_join(F.transform("steps", lambda s: F.concat_ws("|", s["index"].cast("string"), s["tool"], s["args"], s["result"], s["note"])), "\n")
        return found.select("case_id", "variant_id", listed.alias("steps"), "notes", "problem")

    return query


def row_fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = A.baselines(spark, sf_dir).select("case_id", F.lit("baseline").alias("variant_id"), F.lit("baseline").alias("variant_type"), "text", "notes")
    return cases.select("case_id", row_fingerprint(CASE_FIELDS).alias("fingerprint"))


def sentence_split_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.baselines(spark, sf_dir).withColumn("text", A.in_chinese(F.col("text")))
    return docs.select("case_id", F.posexplode(T.sentences(F.col("text"), CHINESE)).alias("at", "sentence")).select("case_id", (F.col("at") + 1).cast("long").alias("number"), "sentence")


def review_checks_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals with measure words, and negations counted wherever they stand."""
    drafts = A.drafts(spark, sf_dir).withColumns({c: A.in_chinese(F.col(c)) for c in ("baseline_text", "draft_text")})
    found = paraphrase.checked(drafts, CHINESE)
    return found.select("case_id", F.array_join("blocking_checks", "; ").alias("blocking_checks"), F.array_join("review_notes", "; ").alias("review_notes"), "status")


def traj_render_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = A.trajectories(spark, sf_dir)
    return cases.select("case_id", trajectory.render(F.col("steps"), F.col("task"), F.col("final_answer"), CHINESE).alias("text"))


def traj_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories written as JSON lines and read again: steps numbered, arguments in one order of keys."""
    steps = F.transform("steps", lambda s: F.struct(F.concat(F.lit(" "), s["tool"]).alias("tool"), F.struct(s["index"].alias("z"), F.lit("x").alias("a")).alias("args"), s["result"].alias("result"), s["note"].alias("note")))
    line = F.to_json(F.struct("case_id", "task", steps.alias("steps"), F.concat(F.lit("the answer of "), "case_id").alias("final_answer"), "load_bearing_steps", "independent_steps"))
    found = trajectories.parse_lines(A.trajectories(spark, sf_dir).select(F.col("ordinal"), line.alias("value")))
    listed = F.array_join(F.transform("steps", lambda s: F.concat_ws("|", s["index"].cast("string"), s["tool"], s["args"], s["result"], s["note"])), "\n")
    return found.select("ordinal", "case_id", listed.alias("steps"), "final_answer", "problem")


def generate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every baseline with all its variants, numbered in file order."""
    return variants.generate(_split_baselines(spark, sf_dir).drop("sentences"), language=A.PLAIN, paraphrase=variants.PARAPHRASE, seed=SEED).select("row_order", "case_id", "variant_id", "variant_type", "text", "notes")


def traj_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.generate(A.trajectories(spark, sf_dir), language=ENGLISH, seed=SEED).select("row_order", "case_id", "variant_id", "variant_type", "notes", "problem")


def merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row of a merged file stands: as generated, then foreign rows as in their file."""
    merged = variants.merge(_generated(spark, sf_dir), _existing(spark, sf_dir))
    return numbered(kept(merged.orderBy("is_foreign", "at").select("case_id", "variant_id", "is_foreign")), "position")


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score table as it is written: numbers as text with ten significant digits."""
    return csv_tables.score_layout(A.scores(spark, sf_dir).withColumn("notes", F.lit("")))


def review_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of drafts as it is written for review."""
    checked = paraphrase.checked(A.drafts(spark, sf_dir), ENGLISH)
    return csv_tables.review_layout(checked.withColumns({"baseline_sha256": text_hash(F.col("baseline_text")), "ordinal": F.col("case_id").cast("long")}))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        audit_findings, audit_case_margins, audit_summary, audit_risk, audit_headroom, audit_uncertainty, audit_nested_cases, evidence_grade, strategy_mean_delta,
        score_row_violations, pairing_violations, duplicate_keys, compare_findings, compare_status_counts, compare_metrics, compare_totals, compare_identity_diff,
        compare_self_consistency, report_order, repeat_aggregate, token_totals, latency_totals, resume_missing, resume_foreign, resume_mismatch, planned_samples,
        sentence_split, sentence_split_english, sentence_split_chinese, merge_classify, merge_origin, merge_order, review_checks, review_tally, ratified_rows, traj_render, review_checks_chinese, traj_render_chinese, traj_parse, generate_all, traj_generate, score_table, review_table,
    )
} | {
    "gaming_verbose_padding": _variant("verbose_padding"),
    "gaming_rubric_flattery": _variant("rubric_flattery"),
    "degradation_remove_evidence": _variant("remove_evidence", A.PLAIN),
    "degradation_unsupported_assertion": _variant("unsupported_assertion", A.PLAIN),
    "paraphrase_connective_substitution": connective_substitution,
    "traj_redundant_tool_calls": _trajectory("redundant_tool_calls"),
    "traj_padded_reasoning": _trajectory("padded_reasoning"),
    "traj_remove_load_bearing_step": _trajectory("remove_load_bearing_step"),
    "traj_hollow_evidence": _trajectory("hollow_evidence"),
    "traj_reorder_independent_steps": _trajectory("reorder_independent_steps"),
    "row_fingerprint": row_fingerprint_query,
}
ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
