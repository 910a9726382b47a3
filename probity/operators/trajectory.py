"""Trajectories: rendering, and variants of step sequences whose postconditions can be checked exactly.

All edits are higher-order functions over the array of steps; nothing is exploded or shuffled.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.functions import text as T
from probity.functions.languages import CHINESE, Language
from probity.operators.variants import hashed_pick
from probity.refusals import Refusal

GAMING = ("redundant_tool_calls", "padded_reasoning")
DEGRADATION = ("remove_load_bearing_step", "hollow_evidence")
PARAPHRASE = ("reorder_independent_steps",)
REPEATED = 2


def family_of(strategy: str) -> str:
    for family, names in (("gaming", GAMING), ("degradation", DEGRADATION), ("paraphrase", PARAPHRASE)):
        if strategy in names:
            return family
    raise Refusal(f"Unknown trajectory strategy {strategy!r}; known are {', '.join((*GAMING, *DEGRADATION, *PARAPHRASE))}.")


def render(steps: Column, task: Column, answer: Column, language: Language = CHINESE) -> Column:
    """The transcript that a grader sees; steps are numbered by place, and an empty note has no line."""
    words = language.labels

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"  {label}{words.mark}"), value)

    def step(s: Column, i: Column) -> Column:
        return F.filter(
            F.array(
                F.concat(F.lit(f"{words.step} "), (i + 1).cast("string")), line(words.tool, s["tool"]), line(words.args, s["args"]), line(words.result, s["result"]),
                F.when(F.coalesce(s["note"], F.lit("")) != "", line(words.note, s["note"])), F.lit(""),
            ),
            lambda x: x.isNotNull(),
        )

    head = F.array(F.concat(F.lit(words.task + words.mark), task), F.lit(""))
    return F.array_join(F.concat(head, F.flatten(F.transform(steps, step)), F.array(F.concat(F.lit(words.answer + words.mark), answer))), "\n")


def renumber(steps: Column) -> Column:
    return F.transform(steps, lambda s, i: s.withField("index", (i + 1).cast("long")))


def identities(steps: Column) -> Column:
    """What each step did: tool, arguments and result, whatever its place or narration."""
    return F.transform(steps, lambda s: F.struct(s["tool"].alias("tool"), s["args"].alias("args"), s["result"].alias("result")))


def collapse(steps: Column) -> Column:
    """Identities with adjacent repeats taken together."""
    found = identities(steps)
    return F.filter(found, lambda s, i: (i == 0) | (s != F.element_at(found, F.greatest(i, F.lit(1)))))


def hashed_draws(strategy: str, seed: int, language: Language) -> Column:
    """Picks by hash: places (from 1) of the steps to repeat, or an index of a stock sentence for every step."""
    n = F.size("steps")
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{strategy}|0|"), F.col("case_id")).cast("binary")), 1, 8), 16, 10).cast("long")
    if strategy == "redundant_tool_calls":
        first = (digest % n).cast("int") + 1
        return F.when(n < REPEATED, F.array(first)).otherwise(F.array_sort(F.array(first, first % n + 1)))
    if strategy == "padded_reasoning":
        first = hashed_pick(seed, strategy, len(language.padding))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((first + i) % len(language.padding)).cast("int"))
    return F.array().cast("array<int>")


def seeded_draws(cases: Sequence[tuple[int, int]], strategies: Sequence[str], seed: int, language: Language) -> list[tuple[int, str, list[int]]]:
    """As one seeded generator draws them, over (ordinal, number of steps) in file order."""
    generator = random.Random(seed)
    found = []
    for ordinal, steps in cases:
        for strategy in strategies:
            picks: list[int] = []
            if strategy == "redundant_tool_calls":
                picks = [p + 1 for p in sorted(generator.sample(range(steps), min(REPEATED, steps)))]
            elif strategy == "padded_reasoning":
                picks = [generator.randrange(len(language.padding)) for _ in range(steps)]
            found.append((ordinal, strategy, picks))
    return found


def _build(strategy: str, language: Language) -> tuple[Column, Column, Column, list[tuple[str, Column]]]:
    """Steps, inserted text, magnitude, and (problem, when broken)."""
    steps, bearing, groups = F.col("steps"), F.col("load_bearing_steps"), F.col("independent_steps")
    none = F.array().cast("array<string>")
    picks = F.col("picks")

    def shown(numbers: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(numbers.cast("array<string>"), ", "), F.lit("]"))

    if strategy == "redundant_tool_calls":
        made = renumber(F.flatten(F.transform(steps, lambda s, i: F.when(F.array_contains(picks, i + 1), F.array(s, s)).otherwise(F.array(s)))))
        size = F.concat(F.lit("added_steps="), (F.size(made) - F.size(steps)).cast("string"), F.lit(" repeated_steps="), shown(picks))
        return made, none, size, [
            ("must add steps", F.size(made) <= F.size(steps)),
            ("invented a call", F.size(F.array_except(identities(made), identities(steps))) > 0),
            ("changed the sequence of the baseline", collapse(made) != identities(steps)),
        ]
    if strategy == "padded_reasoning":
        stock = F.array(*map(F.lit, language.padding))
        chosen = F.transform(picks, lambda k: F.element_at(stock, k + 1))
        made = renumber(F.transform(steps, lambda s, i: s.withField("note", T.strip(F.concat(F.coalesce(s["note"], F.lit("")), F.lit(language.separator), F.element_at(chosen, i + 1))))))

        def notes(x: Column) -> Column:
            return F.aggregate(x, F.lit(0), lambda total, s: total + F.length(F.coalesce(s["note"], F.lit(""))))

        added = F.aggregate(chosen, F.lit(0), lambda total, s: total + F.length(s))
        size = F.concat(F.lit("added_note_characters="), added.cast("string"), F.lit(" padded_steps="), shown(F.transform(steps, lambda s: s["index"])))
        return made, chosen, size, [("changed what was done", identities(made) != identities(steps)), ("added no narration", notes(made) <= notes(steps))]
    if strategy == "remove_load_bearing_step":
        made = renumber(F.filter(steps, lambda s: ~F.array_contains(bearing, s["index"])))
        size = F.concat(F.lit("remaining_steps="), F.size(made).cast("string"), F.lit(" removed_steps="), shown(F.array_sort(bearing)))
        return made, none, size, [("leaves no step at all", F.size(made) == 0), ("kept a load-bearing step or lost another", F.size(made) + F.size(F.array_distinct(bearing)) != F.size(steps))]
    if strategy == "hollow_evidence":
        made = F.transform(steps, lambda s: F.when(F.array_contains(bearing, s["index"]), s.withField("result", F.lit(language.empty_result))).otherwise(s))
        hollowed = F.filter(steps, lambda s: F.array_contains(bearing, s["index"]))
        removed = F.aggregate(hollowed, F.lit(0), lambda total, s: total + F.length(s["result"]))
        size = F.concat(F.lit("hollowed_steps="), shown(F.array_sort(bearing)), F.lit(" removed_result_characters="), removed.cast("string"))
        blank = F.exists(hollowed, lambda s: T.strip(s["result"]) == "")
        left = F.exists(hollowed, lambda s: F.contains(F.lit(language.empty_result), s["result"]))
        return renumber(made), F.array(F.lit(language.empty_result)), size, [("finds a load-bearing step that returns nothing already", blank), ("left an original result in place", left)]
    if strategy == "reorder_independent_steps":
        # within each group every place takes the step of the next place, the last that of the first
        def source(place: Column) -> Column:
            group = F.element_at(F.filter(groups, lambda g: F.array_contains(g, place)), 1)
            at = F.array_position(group, place)
            return F.coalesce(F.element_at(group, (at % F.size(group) + 1).cast("int")), place)

        made = renumber(F.transform(steps, lambda s: F.element_at(steps, F.coalesce(F.when(F.exists(groups, lambda g: F.array_contains(g, s["index"])), source(s["index"])), s["index"]).cast("int"))))
        size = F.concat(F.lit("reordered_groups=["), F.array_join(F.transform(groups, shown), ", "), F.lit("]"))
        return made, none, size, [
            ("finds no steps that are declared independent", F.coalesce(F.size(groups), F.lit(0)) <= 0),
            ("changed which calls were made", F.array_sort(identities(made)) != F.array_sort(identities(steps))),
            ("moved nothing: the declared steps are the same", identities(made) == identities(steps)),
        ]
    raise Refusal(f"Unknown trajectory strategy {strategy!r}.")


def variant(cases: DataFrame, strategy: str, language: Language = CHINESE, *, seed: int = 0, draws: DataFrame | None = None) -> DataFrame:
    """One variant per trajectory: a row of a case file, its steps, magnitude, and the broken postcondition if any."""
    family = family_of(strategy)
    picked = cases.withColumn("picks", hashed_draws(strategy, seed, language)) if draws is None else cases.join(draws.where(F.col("strategy") == strategy).drop("strategy"), "ordinal")
    groups_needed = strategy == "reorder_independent_steps"
    made, inserted, size, rules = _build(strategy, language)
    guarded = F.when(F.coalesce(F.size("independent_steps"), F.lit(0)) > 0, made).otherwise(F.col("steps")) if groups_needed else made
    problem = F.coalesce(*(F.when(wrong, F.lit(f"{strategy} {why}.")) for why, wrong in rules), F.lit(None).cast("string"))
    out = picked.select("*", guarded.alias("made"), inserted.alias("inserted_text"), size.alias("magnitude"), problem.alias("problem"))
    return out.select(
        "ordinal", "case_id", F.lit(f"{family}_{strategy}").alias("variant_id"), F.lit(family).alias("variant_type"), render(F.col("made"), F.col("task"), F.col("final_answer"), language).alias("text"),
        F.concat_ws(" | ", F.lit(f"generated={strategy}"), "magnitude").alias("notes"), F.lit(strategy).alias("strategy"), "inserted_text", "magnitude", "problem", F.col("made").alias("steps"),
    )


def generate(cases: DataFrame, *, gaming: Sequence[str] = GAMING, degradation: Sequence[str] = DEGRADATION, paraphrase: Sequence[str] = PARAPHRASE, language: Language = CHINESE, seed: int = 0, draws: DataFrame | None = None) -> DataFrame:
    """Every baseline transcript and its variants, in file order by ``row_order``."""
    for family, chosen, known, needed in (("gaming", gaming, GAMING, True), ("degradation", degradation, DEGRADATION, True), ("paraphrase", paraphrase, PARAPHRASE, False)):
        if needed and not chosen:
            raise Refusal(f"At least one {family} strategy is needed: every case must have such a variant.")
        for name in chosen:
            if name not in known:
                raise Refusal(f"{name!r} is not a {family} strategy; those are {', '.join(known)}.")
    strategies = (*gaming, *degradation, *paraphrase)
    none = F.lit(None).cast("string")
    rows = cases.select(
        "ordinal", "case_id", F.lit("baseline").alias("variant_id"), F.lit("baseline").alias("variant_type"), render(F.col("steps"), F.col("task"), F.col("final_answer"), language).alias("text"),
        F.when(F.coalesce("notes", F.lit("")) != "", F.col("notes")).otherwise("generated=trajectory_baseline").alias("notes"),
        none.alias("strategy"), F.array().cast("array<string>").alias("inserted_text"), none.alias("magnitude"), none.alias("problem"), F.lit(0).alias("place"),
    )
    for place, strategy in enumerate(strategies, 1):
        rows = rows.unionByName(variant(cases, strategy, language, seed=seed, draws=draws).drop("steps").withColumn("place", F.lit(place)))
    return rows.withColumn("row_order", F.col("ordinal") * (len(strategies) + 1) + F.col("place")).drop("place")
