"""Text variants with checked postconditions, their merge into edited case files, and ratified rewrites.

Random picks come from a table of draws. ``seeded_draws`` replays one seeded generator over the cases in file order, as a single
sequence; ``hashed_draws`` picks by a hash of seed, case and strategy, needs no order and no driver, and is meant for large sets.
The two give different picks, and manifests name the mode.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions import text as T
from probity.functions.fingerprint import text_hash
from probity.functions.languages import CHINESE, Language
from probity.refusals import Refusal, Rule, check

GAMING = ("verbose_padding", "rubric_flattery")
DEGRADATION = ("remove_evidence", "unsupported_assertion")
PARAPHRASE = ("connective_substitution",)
PADDING_COUNT = 2
CASE_COLUMNS = ("case_id", "variant_id", "variant_type", "text", "notes")


@dataclass(frozen=True)
class Strategy:
    """A strategy of a user's own: its family, its columns for a language, and its picks, if it draws any."""

    family: str
    build: Callable[[Language], Built]
    picks: Callable[[int, Language], Column] | None = None


_OWN: dict[str, Strategy] = {}


def register(name: str, strategy: Strategy) -> None:
    """Make a strategy known by ``name``; its picks are hashed ones, since a seeded generator's sequence belongs to the built-in strategies."""
    if strategy.family not in ("gaming", "degradation", "paraphrase"):
        raise Refusal(f"{strategy.family!r} is no family of variants.")
    if name in (*GAMING, *DEGRADATION, *PARAPHRASE):
        raise Refusal(f"The strategy {name!r} is built in.")
    _OWN[name] = strategy


def known_strategies(family: str) -> tuple[str, ...]:
    built_in = {"gaming": GAMING, "degradation": DEGRADATION, "paraphrase": PARAPHRASE}[family]
    return (*built_in, *(name for name, s in _OWN.items() if s.family == family))


def family_of(strategy: str) -> str:
    for family in ("gaming", "degradation", "paraphrase"):
        if strategy in known_strategies(family):
            return family
    raise Refusal(f"Unknown strategy {strategy!r}; known are {', '.join((*GAMING, *DEGRADATION, *PARAPHRASE, *_OWN))}.")


def validate_families(gaming: Sequence[str], degradation: Sequence[str], paraphrase: Sequence[str]) -> None:
    for family, chosen, needed in (("gaming", gaming, True), ("degradation", degradation, True), ("paraphrase", paraphrase, False)):
        if needed and not chosen:
            raise Refusal(f"At least one {family} strategy is needed: every case must have such a variant.")
        for name in chosen:
            if name not in known_strategies(family):
                raise Refusal(f"{name!r} is not a {family} strategy; those are {', '.join(known_strategies(family))}.")


def hashed_pick(seed: int, strategy: str, n: int, number: int = 0) -> Column:
    """An index from 0 to n - 1 by a hash of seed, strategy and case; md5, so that other engines can repeat it."""
    digest = F.md5(F.concat(F.lit(f"{seed}|{strategy}|{number}|"), F.col("case_id")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n).cast("int")


def hashed_draws(strategy: str, seed: int, language: Language) -> Column:
    """The picks of a strategy as an array of indices; two different ones for padding."""
    if strategy in _OWN:
        own = _OWN[strategy].picks
        return own(seed, language) if own else F.array().cast("array<int>")
    if strategy == "verbose_padding":
        n = len(language.padding)
        first, second = hashed_pick(seed, strategy, n), hashed_pick(seed, strategy, n - 1, 1)
        return F.array(first, F.when(second >= first, second + 1).otherwise(second))
    if strategy == "unsupported_assertion":
        return F.array(hashed_pick(seed, strategy, len(language.assertions)))
    return F.array().cast("array<int>")


def seeded_draws(ordinals: Sequence[int], strategies: Sequence[str], seed: int, language: Language) -> list[tuple[int, str, list[int]]]:
    """The picks of one seeded generator, consumed over cases in order and strategies in order."""
    generator = random.Random(seed)
    found = []
    for ordinal in ordinals:
        for strategy in strategies:
            picks: list[int] = []
            if strategy == "verbose_padding":
                picks = generator.sample(range(len(language.padding)), min(PADDING_COUNT, len(language.padding)))
            elif strategy == "unsupported_assertion":
                picks = [generator.choice(range(len(language.assertions)))]
            found.append((ordinal, strategy, picks))
    return found


@dataclass(frozen=True)
class Built:
    """A strategy as columns: the text, what was inserted, its magnitude as text, and what must not hold.

    Magnitude and rules refer to the text as the column ``produced``, so that it is computed once.
    """

    text: Column
    inserted: Column
    magnitude: Column
    rules: list[tuple[str, Column]]


def _picked(options: Sequence[str]) -> Column:
    every = F.array(*map(F.lit, options))
    return F.transform("picks", lambda i: F.element_at(every, i + 1))


def _kept(sentences: Column, evidence: Column) -> Column:
    return F.filter(sentences, lambda s, i: ~F.array_contains(evidence, (i + 1).cast("long")))


def _degradation_rules(text: Column) -> list[tuple[str, Column]]:
    sentences, evidence = F.col("sentences"), F.col("evidence_sentences")
    still = F.exists(evidence, lambda e: F.contains(text, F.element_at(sentences, e.cast("int"))))
    # every kept sentence in order: take them off the front of what is left, null once one is not found
    kept = F.filter(F.transform(_kept(sentences, evidence), T.strip), lambda s: s != "")
    left = F.aggregate(kept, text, lambda rest, s: F.when(F.contains(rest, s), F.substr(rest, F.instr(rest, s) + F.length(s))))
    return [("still contains an annotated sentence", still), ("dropped or moved a sentence that it should keep", left.isNull())]


def build(strategy: str, language: Language) -> Built:
    """Columns over text, sentences, evidence_sentences, picks, and ``produced`` once the text is made."""
    if strategy in _OWN:
        return _OWN[strategy].build(language)
    text, produced, none = F.col("text"), F.col("produced"), F.array().cast("array<string>")
    sentences, evidence = F.col("sentences"), F.col("evidence_sentences")

    def added(made: Column, inserted: Column, count: Column) -> Built:
        wrong = ~F.startswith(produced, text) | (F.length(produced) <= F.length(text))
        size = F.concat(F.lit("added_characters="), (F.length(produced) - F.length(text)).cast("string"), F.lit("; added_sentences="), count.cast("string"))
        return Built(made, inserted, size, [("may add text only", wrong)])

    if strategy == "verbose_padding":
        chosen = _picked(language.padding)
        return added(F.concat(text, F.array_join(F.transform(chosen, lambda s: F.concat(F.lit(language.separator), s)), "")), chosen, F.size(chosen))
    if strategy == "rubric_flattery":
        return added(F.concat(text, F.lit(language.separator + language.flattery)), F.array(F.lit(language.flattery)), F.lit(1))
    if strategy in DEGRADATION:
        joined = F.array_join(_kept(sentences, evidence), "")
        kept = F.btrim(joined, F.lit(language.white))
        if strategy == "remove_evidence":
            made, inserted, removed = kept, none, F.length(text) - F.length(produced)
            more = [("did not shorten the baseline", F.length(produced) >= F.length(text))]
        else:
            claim = F.element_at(_picked(language.assertions), 1)
            made, inserted, removed = F.concat(kept, F.lit(language.separator), claim), F.array(claim), F.length(text) - F.length(joined)
            more = [("did not insert its claim", (claim == "") | ~F.contains(produced, claim))]
        share = T.three_decimals(F.try_divide(removed.cast("double"), F.length(text).cast("double")))
        size = F.concat(F.lit("removed_characters="), removed.cast("string"), F.lit("; removed_sentences="), F.size(evidence).cast("string"), F.lit("; removed_share="), share)
        return Built(made, inserted, size, more + _degradation_rules(produced))
    if strategy in PARAPHRASE:
        count = T.count_connectives(text, language)
        same = T.same_without_connectives(text, produced, language)
        rules = [("found no connective to replace", (count == 0) | (produced == text)), ("changed text outside the connective table", ~same)]
        return Built(T.substitute_connectives(text, language), none, F.concat(F.lit("replaced_connectives="), count.cast("string")), rules)
    raise Refusal(f"Unknown strategy {strategy!r}.")


def _notes(strategy: str, magnitude: Column) -> Column:
    weak = F.lit("weak_probe=surface_only") if family_of(strategy) == "paraphrase" else F.lit(None).cast("string")
    source = F.when(F.coalesce("notes", F.lit("")) != "", F.concat(F.lit("source_note="), "notes"))
    return F.concat_ws(" | ", F.lit(f"generated={strategy}"), magnitude, weak, source)


def variant(cases: DataFrame, strategy: str, language: Language = CHINESE, *, seed: int = 0, draws: DataFrame | None = None) -> DataFrame:
    """One variant per case: the columns of a case file, inserted text, magnitude, and the broken postcondition if any."""
    if draws is None or strategy in _OWN:
        picked = cases.withColumn("picks", hashed_draws(strategy, seed, language))
    else:
        picked = cases.join(draws.where(F.col("strategy") == strategy).drop("strategy"), "ordinal")
    if "sentences" not in cases.columns:
        picked = picked.withColumn("sentences", T.sentences(F.col("text"), language))
    b = build(strategy, language)
    problem = F.coalesce(*(F.when(wrong, F.lit(f"{strategy} {why}.")) for why, wrong in b.rules), F.lit(None).cast("string"))
    family = family_of(strategy)
    return picked.withColumn("produced", b.text).select(
        "ordinal", "case_id", F.lit(f"{family}_{strategy}").alias("variant_id"), F.lit(family).alias("variant_type"), F.col("produced").alias("text"),
        _notes(strategy, b.magnitude).alias("notes"), F.lit(strategy).alias("strategy"), b.inserted.alias("inserted_text"), b.magnitude.alias("magnitude"), problem.alias("problem"),
    )


def generate(cases: DataFrame, *, gaming: Sequence[str] = GAMING, degradation: Sequence[str] = DEGRADATION, paraphrase: Sequence[str] = (), language: Language = CHINESE, seed: int = 0, draws: DataFrame | None = None) -> DataFrame:
    """Every baseline and its variants, ``row_order`` giving file order; nothing is refused here, see ``refuse_problems``."""
    validate_families(gaming, degradation, paraphrase)
    strategies = (*gaming, *degradation, *paraphrase)
    source = F.when(F.coalesce("notes", F.lit("")) != "", F.concat(F.lit("source_note="), "notes"))
    split = cases.withColumn("sentences", T.sentences(F.col("text"), language))
    none = F.lit(None).cast("string")
    rows = cases.select(
        "ordinal", "case_id", F.lit("baseline").alias("variant_id"), F.lit("baseline").alias("variant_type"), "text", F.concat_ws(" | ", F.lit("generated=baseline"), source).alias("notes"),
        none.alias("strategy"), F.array().cast("array<string>").alias("inserted_text"), none.alias("magnitude"), none.alias("problem"), F.lit(0).alias("place"),
    )
    for place, strategy in enumerate(strategies, 1):
        rows = rows.unionByName(variant(split, strategy, language, seed=seed, draws=draws).withColumn("place", F.lit(place)))
    return rows.withColumn("row_order", F.col("ordinal") * (len(strategies) + 1) + F.col("place")).drop("place")


def refuse_problems(rows: DataFrame) -> DataFrame:
    """All or nothing: the first variant that breaks its own postcondition stops the run."""
    message = F.concat(F.lit("Case '"), F.col("case_id"), F.lit("' cannot produce a '"), F.col("strategy"), F.lit("' variant: "), F.col("problem"))
    return check(rows, [Rule("postcondition", F.col("problem").isNotNull(), message)], "row_order")


def merge(generated: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing rows win; each row is appended, preserved, edited or foreign. Order: as generated, then foreign rows as in their file."""
    keys = ["case_id", "variant_id"]
    g = generated.select(*keys, F.struct("variant_type", "text", "notes", F.col("row_order").alias("at")).alias("g"))
    e = existing.select(*keys, F.struct("variant_type", "text", "notes", F.col("ordinal").alias("at")).alias("e"))
    both = g.join(e, keys, "full_outer")
    same = F.col("g.text").eqNullSafe(F.col("e.text")) & F.col("g.notes").eqNullSafe(F.col("e.notes"))
    kind = F.when(F.col("e").isNull(), "appended").when(F.col("g").isNull(), "foreign").when(same, "preserved").otherwise("edited")
    kept = F.coalesce("e", "g")
    return both.select(*keys, kept["variant_type"].alias("variant_type"), kept["text"].alias("text"), kept["notes"].alias("notes"), kind.alias("merge_class"), F.col("g").isNull().alias("is_foreign"), F.coalesce("g.at", "e.at").alias("at"))


def refuse_duplicate_existing(existing: DataFrame) -> None:
    if existing.groupBy("case_id", "variant_id").count().where("count > 1").limit(1).collect():
        raise Refusal("The existing case file repeats a case_id/variant_id pair.")


def merge_origin(merged: DataFrame) -> DataFrame:
    """One row: counts by class, and whether the set is still machine-generated."""
    kinds = ("appended", "preserved", "edited", "foreign")
    row = merged.agg(*(F.count_if(F.col("merge_class") == k).alias(k) for k in kinds))
    return row.withColumn("set_origin", F.when(F.col("edited") + F.col("foreign") > 0, "mixed").otherwise("machine-generated"))


def ratified(review: DataFrame, cases: DataFrame) -> DataFrame:
    """Approved rewrites as variants, with the reason to refuse one in ``problem``."""
    known = cases.select("case_id", text_hash(F.col("text")).alias("expected"))
    approved = review.where("status = 'approved'").join(known, "case_id", "left")
    problem = F.when(F.col("expected").isNull(), F.concat(F.lit("The review names case '"), "case_id", F.lit("', which is not among the baselines."))).when(
        F.col("expected") != F.lower("baseline_sha256"), F.concat(F.lit("Case '"), "case_id", F.lit("' was edited after its rewrite was drafted; draft it anew."))
    )
    note = F.when(F.coalesce("reviewer_note", F.lit("")) != "", F.concat(F.lit("reviewer_note="), "reviewer_note"))
    return approved.select(
        "ordinal", "case_id", F.lit("paraphrase_ratified").alias("variant_id"), F.lit("paraphrase").alias("variant_type"), F.col("draft_text").alias("text"),
        F.concat_ws(" | ", F.lit("generated=human_ratified_paraphrase"), note).alias("notes"), problem.alias("problem"),
    )


def review_tally(review: DataFrame) -> DataFrame:
    """(status, n) of all four statuses, also those that do not occur."""
    statuses = ("pending", "blocked", "approved", "rejected")
    row = review.agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses))
    return row.select(F.inline(F.array(*(F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in statuses))))
