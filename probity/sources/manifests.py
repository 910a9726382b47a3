"""JSON documents that tie the steps together: each names what it read and wrote by hash, and a break in the chain is refused."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from pathlib import Path
from typing import Any

from probity.functions.fingerprint import stable_hash
from probity.operators.audit import AuditConfig
from probity.refusals import Refusal

IDENTITY = ("generator", "language", "seed", "input_sha256", "gaming_strategies", "degradation_strategies", "paraphrase_strategies")


def read_object(path: str | Path, what: str) -> dict[str, Any]:
    file = Path(path)
    if not file.exists():
        raise Refusal(f"{what} does not exist: {file}")
    try:
        found = json.loads(file.read_text(encoding="utf-8"))
    except json.JSONDecodeError as error:
        raise Refusal(f"{what} is malformed: {file}") from error
    if not isinstance(found, dict):
        raise Refusal(f"{what} must hold a JSON object.")
    return found


def write_object(path: str | Path, value: object) -> None:
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8", newline="\n")


def write_text(path: str | Path, text: str) -> None:
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text, encoding="utf-8", newline="\n")


def sha256_of(document: dict[str, Any], key: str, what: str) -> str:
    value = document.get(key)
    if not isinstance(value, str) or not re.fullmatch("[0-9a-fA-F]{64}", value):
        raise Refusal(f"{what}: {key} must be a SHA-256 in hexadecimal.")
    return value.lower()


def text_of(document: dict[str, Any], key: str, what: str) -> str:
    value = document.get(key)
    if not isinstance(value, str) or not value.strip():
        raise Refusal(f"{what}: {key} must be text that is not empty.")
    return value.strip()


def integer_of(document: dict[str, Any], key: str, what: str, least: int = 0, default: int | None = None) -> int:
    value = document.get(key, default)
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise Refusal(f"{what}: {key} must be a whole number of at least {least}.")
    return value


def number_of(document: dict[str, Any], key: str, what: str) -> float:
    """A finite number; text that reads as one will do, a Boolean will not."""
    value = document.get(key)
    try:
        if isinstance(value, bool):
            raise TypeError
        found = float(value)
    except (TypeError, ValueError) as error:
        raise Refusal(f"{what}: {key} must be a number.") from error
    if not math.isfinite(found):
        raise Refusal(f"{what}: {key} must be finite.")
    return found


#: A field's check: (document, key, what it is called in a refusal) to the value.
Check = Callable[[dict[str, Any], str, str], Any]


def flag_of(document: dict[str, Any], key: str, what: str) -> bool:
    if not isinstance(document.get(key), bool):
        raise Refusal(f"{what}: {key} must be true or false.")
    return document[key]


def one_of(*values: str) -> Check:
    def check(document: dict[str, Any], key: str, what: str) -> str:
        if (value := document.get(key)) not in values:
            raise Refusal(f"{what}: unknown {key} {value!r}; it must be one of {', '.join(values)}.")
        return value

    return check


def maybe(check: Check) -> Check:
    """A field that may be absent or null."""
    return lambda document, key, what: None if document.get(key) is None else check(document, key, what)


def at_least(least: float, check: Check) -> Check:
    def bounded(document: dict[str, Any], key: str, what: str) -> Any:
        if (value := check(document, key, what)) < least:
            raise Refusal(f"{what}: {key} must not be less than {least:g}.")
        return value

    return bounded


def whole(least: int = 0) -> Check:
    return lambda document, key, what: integer_of(document, key, what, least)


def plain_text(document: dict[str, Any], key: str, what: str) -> str:
    """Text as it is, the empty one too."""
    if not isinstance(document.get(key), str):
        raise Refusal(f"{what}: {key} must be text.")
    return document[key]


def fields_of(document: object, checks: dict[str, Check], what: str) -> dict[str, Any]:
    """The fields of an object, each as its check returns it."""
    if not isinstance(document, dict):
        raise Refusal(f"{what} must be an object.")
    return {key: check(document, key, what) for key, check in checks.items()}


def list_of(document: dict[str, Any], key: str, what: str, least: int = 0) -> list[Any]:
    """A list of at least so many entries."""
    value = document.get(key)
    if not isinstance(value, (list, tuple)) or len(value) < least:
        raise Refusal(f"{what}: {key} must be a list" + " that is not empty." * bool(least))
    return list(value)


def scoring_context(path: str | Path, records: int, cfg: AuditConfig) -> dict[str, Any]:
    """What two audits must have in common to be compared, from the scorer's manifest."""
    what = "Scoring manifest"
    m = read_object(path, what)
    if integer_of(m, "record_count", what) != records:
        raise Refusal(f"{what}: record_count does not agree with the score table.")
    model, repeats, temperature = text_of(m, "model", what), integer_of(m, "repeats", what, 1, 1), number_of(m, "temperature", what)
    if cfg.has_scale:
        ends = m.get("score_range")
        if not isinstance(ends, list) or len(ends) != 2:
            raise Refusal(f"{what}: score_range must hold two numbers.")
        found = [number_of({"score_range": v}, "score_range", what) for v in ends]
        if any(abs(a - b) > 1e-12 for a, b in zip(found, (cfg.score_min, cfg.score_max))):
            raise Refusal(f"{what}: score_range does not agree with the audit's scale.")
    return {
        "input_sha256": sha256_of(m, "input_sha256", what), "rubric_sha256": sha256_of(m, "rubric_sha256", what), "temperature": temperature,
        "repeats": repeats, "model": model, "generation_sha256": None, "paraphrase_model": None,
    }


def generation_context(path: str | Path, scored_sha256: str, origin: str) -> tuple[str, str | None]:
    """(fingerprint of the generation, model of the rewrites) once the chain from generator to scorer is proven."""
    what = "Generation manifest"
    m = read_object(path, what)
    output, baseline = sha256_of(m, "output_sha256", what), sha256_of(m, "input_sha256", what)
    if output != scored_sha256.lower():
        raise Refusal("The scored cases are not what this generation manifest describes: they were changed afterwards. Their origin is mixed.")
    if origin == "machine-generated" and m.get("set_origin", "machine-generated") != origin:
        raise Refusal("The generation manifest says that rows were written or changed by hand: the origin is mixed, not machine-generated.")
    if origin == "human-authored":
        raise Refusal("A generator made these cases, so they are not human-authored.")
    integer_of(m, "seed", what, least=-(2**63))
    for key in ("generator", "language"):
        text_of(m, key, what)
    for key in IDENTITY[-3:]:
        if not isinstance(m.get(key), list) or not all(isinstance(x, str) for x in m[key]):
            raise Refusal(f"{what}: {key} must be a list of texts.")
    model = None if m.get("paraphrase_model") is None else text_of(m, "paraphrase_model", what)
    return stable_hash({k: m[k] for k in IDENTITY} | {"input_sha256": baseline}), model


def rewriting_model(path: str | Path) -> str:
    """The model that drafted the rewrites: a missing manifest is an error, never a guess."""
    return text_of(read_object(path, "Drafting manifest"), "paraphrase_model", "Drafting manifest")


def beside(path: str | Path) -> Path:
    """Where the manifest of a table lies if no other place is named."""
    return Path(path).with_suffix(".manifest.json")


def refuse_same_model(rewriter: str | None, grader: str) -> None:
    if rewriter and rewriter.casefold() == grader.casefold():
        raise Refusal(f"{rewriter!r} both drafted the rewrites and scored them: it would define what it is tested on.")
