"""Trajectories from JSON lines. Types are strict: a Boolean is no number, and text is no list."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.refusals import Refusal, refuse_first
from probity.sources.tables import numbered

STEP = "struct<index:long,tool:string,args:string,result:string,note:string>"
SCHEMA = f"ordinal long, case_id string, task string, steps array<{STEP}>, final_answer string, load_bearing_steps array<long>, independent_steps array<array<long>>, notes string, problem string"


def _text(row: dict[str, Any], key: str) -> str:
    value = row.get(key)
    if not isinstance(value, str) or not value.strip():
        raise Refusal(f"{key} must be text that is not empty.")
    return value.strip()


def _numbers(value: object, key: str) -> list[int]:
    if not isinstance(value, list) or any(isinstance(v, bool) or not isinstance(v, int) for v in value):
        raise Refusal(f"{key} must be a list of whole numbers.")
    return value


def canonical_args(value: object) -> str:
    """Arguments as they are if text, else JSON with sorted keys: the same call always has the same bytes."""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def parse_steps(value: object) -> list[dict[str, Any]]:
    if not isinstance(value, list):
        raise Refusal("steps must be a list.")
    if not value:
        raise Refusal("a trajectory needs at least one step.")
    steps = []
    for n, item in enumerate(value, 1):
        if not isinstance(item, dict):
            raise Refusal(f"step {n} must be an object.")
        tool = item.get("tool")
        if not isinstance(tool, str) or not tool.strip():
            raise Refusal(f"step {n} must name a tool.")
        for key in ("result", "note"):
            if not isinstance(item.get(key, ""), str):
                raise Refusal(f"step {n}: {key} must be text.")
        steps.append({"index": n, "tool": tool.strip(), "args": canonical_args(item.get("args", {})), "result": item.get("result", ""), "note": item.get("note", "")})
    return steps


def check_annotations(bearing: list[int], groups: list[list[int]], n: int, case_id: str) -> None:
    """Load-bearing steps and groups of independent ones are declared by people and must make sense."""
    def outside(numbers: list[int]) -> bool:
        return any(not 1 <= k <= n for k in numbers)

    case = f"Case {case_id!r}"
    if not bearing:
        raise Refusal(f"{case} has no load_bearing_steps; they are declared, never inferred.")
    if len(set(bearing)) < len(bearing):
        raise Refusal(f"{case} repeats one of its load_bearing_steps.")
    if outside(bearing):
        raise Refusal(f"{case} has load_bearing_steps outside 1 to {n}.")
    if len(bearing) == n:
        raise Refusal(f"{case} declares all steps load-bearing; nothing would be left.")
    seen: set[int] = set()
    for group in groups:
        if len(group) < 2:
            raise Refusal(f"{case} has a group of independent_steps with fewer than two members.")
        if len(set(group)) < len(group):
            raise Refusal(f"{case} repeats a step within a group of independent_steps.")
        if outside(group):
            raise Refusal(f"{case} has independent_steps outside 1 to {n}.")
        if seen & set(group):
            raise Refusal(f"{case} has step {min(seen & set(group))} in more than one group of independent_steps.")
        seen.update(group)


def parse(line: str) -> dict[str, Any]:
    try:
        row = json.loads(line)
    except json.JSONDecodeError as error:
        raise Refusal("malformed JSON.") from error
    if not isinstance(row, dict):
        raise Refusal("a line must hold an object.")
    case_id = _text(row, "case_id")
    steps = parse_steps(row.get("steps"))
    bearing = _numbers(row.get("load_bearing_steps", []), "load_bearing_steps")
    groups = row.get("independent_steps", [])
    if not isinstance(groups, list):
        raise Refusal("independent_steps must be a list of lists.")
    groups = [_numbers(g, "independent_steps") for g in groups]
    check_annotations(bearing, groups, len(steps), case_id)
    notes = row.get("notes", "")
    return {
        "case_id": case_id, "task": _text(row, "task"), "steps": steps, "final_answer": _text(row, "final_answer"), "load_bearing_steps": bearing,
        "independent_steps": groups, "notes": notes if isinstance(notes, str) else "", "problem": None,
    }


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parsed trajectories from (ordinal, value); a line that cannot be read has only ``problem``."""
    names = [part.strip().split(" ")[0] for part in "ordinal, case_id, task, steps, final_answer, load_bearing_steps, independent_steps, notes, problem".split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ordinal, line in zip(batch["ordinal"], batch["value"]):
                try:
                    rows.append({"ordinal": ordinal, **parse(line)})
                except Refusal as error:
                    rows.append(dict.fromkeys(names) | {"ordinal": ordinal, "problem": f"Line {ordinal}: {error}"})
            yield pd.DataFrame(rows, columns=names)

    return lines.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "").mapInPandas(run, SCHEMA)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Annotated trajectories, in file order by ``ordinal`` (lines count from 1, blank ones too)."""
    spark.catalog.refreshByPath(path)  # the file may have been written anew while an older reading of it is cached
    try:
        lines = spark.read.text(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise Refusal(f"Trajectory file does not exist: {path}") from error
        raise
    found = parse_lines(numbered(lines, "ordinal").select("ordinal", F.regexp_replace("value", "^﻿", "").alias("value"))).cache()
    refuse_first(found.where("problem is not null").select("ordinal", F.lit(0).alias("rule_no"), F.lit("line").alias("rule_id"), F.col("problem").alias("message")))
    twice = found.groupBy("case_id").agg(F.count("*").alias("n"), F.max("ordinal").alias("ordinal")).where("n > 1")
    refuse_first(twice.select("ordinal", F.lit(0).alias("rule_no"), F.lit("twice").alias("rule_id"), F.concat(F.lit("Duplicate case_id '"), "case_id", F.lit("'.")).alias("message")))
    if found.limit(1).count() == 0:
        raise Refusal(f"The trajectory file holds no trajectories: {path}")
    return found.drop("problem")
