"""CSV sources with validation, and the sinks that write what they read.

Every reader reads all columns as text, numbers the records from 2 as a spreadsheet does, checks them, and only then gives a typed
table. Small driver files and cluster-sized folders take the same path: a file that is not split keeps its record numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from probity.functions import text as T
from probity.functions.languages import CHINESE, Language
from probity.operators.audit import VARIANT_TYPES
from probity.refusals import Refusal, Rule, check, refuse_first
from probity.sources.tables import numbered

SCORE_COLUMNS = ("system_name", "case_id", "variant_id", "variant_type", "score")
CASE_COLUMNS = ("case_id", "variant_id", "variant_type", "text")
BASELINE_COLUMNS = ("case_id", "text", "evidence_sentences")
REVIEW_COLUMNS = ("case_id", "baseline_sha256", "draft_text", "status")
REVIEW_ORDER = ("case_id", "baseline_sha256", "baseline_text", "draft_text", "status", "blocking_checks", "review_notes", "reviewer_note")
STATUSES = ("pending", "blocked", "approved", "rejected")
#: What Python reads as a number; Spark alone would also take 1d, and refuse spaces.
NUMBER = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+)?$|^(?i)[+-]?(?:nan|inf|infinity)$"
INTEGER = r"^[+-]?[0-9]+(?:_[0-9]+)*$"


def read_text_table(spark: SparkSession, path: str, required: Sequence[str], optional: Sequence[str] = (), what: str = "Input") -> DataFrame:
    """Columns as stripped text, null as empty, with ``ordinal`` the record number from 2; other columns are left out."""
    spark.catalog.refreshByPath(path)  # the file may have been written anew while an older reading of it is cached
    try:
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').option("encoding", "UTF-8").option("enforceSchema", False).csv(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise Refusal(f"{what} file does not exist: {path}") from error
        raise
    if not raw.columns:
        raise Refusal(f"{what} CSV has no header row.")
    names = {c.lstrip("﻿"): c for c in raw.columns}
    missing = sorted(set(required) - set(names))
    if missing:
        raise Refusal(f"{what} CSV is missing columns: {', '.join(missing)}")

    def cell(name: str) -> Column:
        return T.strip(F.coalesce(F.col(f"`{names[name]}`"), F.lit(""))) if name in names else F.lit("")

    return numbered(raw, "__record", first=2).select(F.col("__record").alias("ordinal"), *(cell(c).alias(c) for c in (*required, *optional)))


def number(text: Column) -> Column:
    """A double where Python would read one, else null."""
    return F.when(text.rlike(NUMBER), F.regexp_replace(F.lower(text), "_", "").try_cast("double"))


def _row(message: str | Column) -> Column:
    return F.concat(F.lit("Row "), F.col("ordinal").cast("string"), F.lit(": "), F.lit(message) if isinstance(message, str) else message)


def _empty(columns: Sequence[str]) -> Rule:
    found = F.concat_ws(", ", *(F.when(F.col(c) == "", F.lit(c)) for c in columns))
    return Rule("empty", found != "", _row(F.concat(F.lit("empty required values: "), found, F.lit("."))))


def _type(column: str = "variant_type") -> Rule:
    return Rule("variant_type", ~F.col(column).isin(*VARIANT_TYPES), _row(F.concat(F.lit("the variant_type '"), F.col(column), F.lit("' is not one of " + ", ".join(VARIANT_TYPES) + "."))))


def _refuse_empty(df: DataFrame, what: str) -> DataFrame:
    if df.limit(1).count() == 0:
        raise Refusal(f"The {what} CSV holds no records.")
    return df


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A score table: system_name, case_id, variant_id, variant_type, score, score_stddev, sample_count, notes, ordinal."""
    raw = read_text_table(spark, path, SCORE_COLUMNS, ("score_stddev", "sample_count", "notes")).withColumn("variant_type", F.lower("variant_type"))
    raw = raw.withColumns({"x": number(F.col("score")), "s": number(F.col("score_stddev")), "n": F.when(F.col("sample_count") == "", F.lit(1).cast("long")).when(F.col("sample_count").rlike(INTEGER), F.regexp_replace("sample_count", "_", "").try_cast("long"))})
    x, s, n = F.col("x"), F.col("s"), F.col("n")
    given = F.col("score_stddev") != ""
    check(_refuse_empty(raw, "score"), [
        _type(), Rule("score", x.isNull(), _row("score must be a number.")), Rule("score_finite", ~finite(x), _row("score must be finite.")),
        Rule("stddev", given & s.isNull(), _row("score_stddev must be a number.")), Rule("stddev_finite", given & (~finite(s) | (s < 0)), _row("score_stddev must be finite and not negative.")),
        Rule("count", n.isNull(), _row("sample_count must be a whole number.")), Rule("count_positive", n < 1, _row("sample_count must be at least 1.")),
        Rule("stddev_missing", (n > 1) & ~given, _row("score_stddev is needed where sample_count is over 1.")), Rule("stddev_single", (n == 1) & given & (s != 0), _row("score_stddev must be empty or 0 where sample_count is 1.")),
        _empty(("system_name", "case_id", "variant_id")),
    ])
    return raw.select("system_name", "case_id", "variant_id", "variant_type", x.alias("score"), s.alias("score_stddev"), n.alias("sample_count"), "notes", "ordinal")


def refuse_repeated_keys(df: DataFrame, keys: Sequence[str]) -> None:
    """The first record that repeats a key, found by an aggregation."""
    again = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max("ordinal").alias("ordinal")).where("n > 1")
    message = F.concat(F.lit("Row "), F.col("ordinal").cast("string"), F.lit(": duplicate " + "/".join(keys) + " "), F.concat_ws("/", *keys), F.lit("."))
    refuse_first(again.select("ordinal", F.lit(0).alias("rule_no"), F.lit("duplicate").alias("rule_id"), message.alias("message")))


def refuse_unpaired(df: DataFrame) -> None:
    """Each case needs exactly one baseline, a gaming and a degradation variant."""
    from probity.operators.audit import pairing

    found = pairing(df).withColumn("problem", F.when(F.col("baselines") != 1, F.concat(F.lit("must have exactly one baseline; found "), F.col("baselines").cast("string"))).when(
        ~F.col("has_gaming") | ~F.col("has_degradation"), F.concat(F.lit("lacks paired variants: "), F.concat_ws(", ", F.when(~F.col("has_degradation"), F.lit("degradation")), F.when(~F.col("has_gaming"), F.lit("gaming"))))
    ))
    message = F.concat(F.lit("Case '"), F.col("case_id"), F.lit("' "), F.col("problem"), F.lit("."))
    refuse_first(found.where("problem is not null").select(F.col("case_id").alias("ordinal"), F.lit(0).alias("rule_no"), F.lit("paired").alias("rule_id"), message.alias("message")))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A case table: case_id, variant_id, variant_type, text, notes, ordinal."""
    raw = read_text_table(spark, path, CASE_COLUMNS, ("notes",)).withColumn("variant_type", F.lower("variant_type"))
    check(_refuse_empty(raw, "case"), [_empty(CASE_COLUMNS), _type()])
    refuse_repeated_keys(raw, ("case_id", "variant_id"))
    refuse_unpaired(raw)
    return raw.select("case_id", "variant_id", "variant_type", "text", "notes", "ordinal")


def evidence_indices(text: Column) -> Column:
    """Sorted indices from a list such as ``2, 3``; null where one is not a positive whole number."""
    parts = F.filter(F.transform(F.split(text, ","), T.strip), lambda p: p != "")
    numbers = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), p.try_cast("long")))
    return F.when(~F.exists(numbers, lambda k: k.isNull() | (k < 1)), F.array_sort(numbers))


def read_baselines(spark: SparkSession, path: str, language: Language = CHINESE) -> DataFrame:
    """Annotated baselines: case_id, text, evidence_sentences, notes, ordinal. Annotations are read, never inferred."""
    raw = read_text_table(spark, path, BASELINE_COLUMNS, ("notes", "sentence_count"))
    check(_refuse_empty(raw, "baseline"), [_empty(("case_id", "text"))])
    refuse_repeated_keys(raw, ("case_id",))
    parsed = raw.withColumns({"sentences": T.sentences(F.col("text"), language), "evidence": evidence_indices(F.col("evidence_sentences")), "declared": F.when(F.col("sentence_count").rlike("^[0-9]+$"), F.col("sentence_count").try_cast("long"))})
    n, ev, declared = F.size("sentences"), F.col("evidence"), F.col("declared")
    said = F.col("sentence_count") != ""
    check(parsed, [
        Rule("declared", said & (declared.isNull() | (declared < 1)), _row("sentence_count must be a positive whole number.")),
        Rule("disagrees", said & (declared != n), _row(F.concat(F.lit("sentence_count says "), F.col("sentence_count"), F.lit(f" but the {language.name} splitter found "), n.cast("string"), F.lit(".")))),
        Rule("two_sentences", n < 2, _row("a baseline needs at least two sentences, so that something is left without the evidence.")),
        Rule("evidence_empty", F.size(F.filter(F.split("evidence_sentences", ","), lambda p: T.strip(p) != "")) == 0, _row("evidence_sentences must not be empty.")),
        Rule("evidence_number", ev.isNull(), _row("evidence_sentences must be positive whole numbers.")),
        Rule("evidence_twice", F.size(F.array_distinct(ev)) != F.size(ev), _row("evidence_sentences repeats an index.")),
        Rule("evidence_range", F.array_max(ev) > n, _row(F.concat(F.lit("evidence_sentences names sentence "), F.array_max(ev).cast("string"), F.lit(" of "), n.cast("string"), F.lit(".")))),
        Rule("evidence_all", F.size(ev) == n, _row("not every sentence can be evidence; nothing would be left.")),
    ])
    return parsed.select("case_id", "text", ev.alias("evidence_sentences"), "notes", "ordinal", "sentences")


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A reviewed table of drafts: case_id, baseline_sha256, draft_text, status, reviewer_note, ordinal."""
    raw = read_text_table(spark, path, REVIEW_COLUMNS, ("reviewer_note",), what="Review")
    check(_refuse_empty(raw, "review"), [_empty(REVIEW_COLUMNS), Rule("status", ~F.col("status").isin(*STATUSES), _row(F.concat(F.lit("status must be one of " + ", ".join(STATUSES) + "; found '"), F.col("status"), F.lit("'."))))])
    return raw.withColumn("baseline_sha256", F.lower("baseline_sha256"))


@F.pandas_udf(StringType())
def ten_digits(values: pd.Series) -> pd.Series:
    """As C's %.10g; null is empty."""
    return values.map(lambda v: "" if pd.isna(v) else f"{v:.10g}")


def score_layout(scores: DataFrame) -> DataFrame:
    columns = ["system_name", "case_id", "variant_id", "variant_type", ten_digits("score").alias("score"), ten_digits("score_stddev").alias("score_stddev"), F.col("sample_count").cast("string").alias("sample_count"), "notes"]
    # by the key too: where many rows have one ordinal, no task should get them all
    return scores.orderBy("ordinal", "case_id", "variant_id").select(*columns)


def review_layout(drafts: DataFrame) -> DataFrame:
    return drafts.orderBy("ordinal").select(
        "case_id", "baseline_sha256", "baseline_text", "draft_text", "status", F.array_join("blocking_checks", "; ").alias("blocking_checks"), F.array_join("review_notes", "; ").alias("review_notes"), F.lit("").alias("reviewer_note")
    )


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A folder of CSV parts, written by the executors, quoted so that the readers above take it back without loss."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
