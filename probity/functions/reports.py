"""Reports in Markdown and in self-contained HTML. They format collected results; every figure was computed before."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from html import escape
from typing import Any

from probity.operators.compare import METRICS, STATUSES

TITLES = {
    "mean_gaming_gain": "Mean gaming gain", "worst_gaming_gain": "Largest gaming gain", "mean_degradation_drop": "Mean degradation drop",
    "weakest_degradation_drop": "Weakest degradation drop", "mean_paraphrase_delta": "Mean paraphrase change", "mean_validity_margin": "Mean validity margin",
}
STYLE = "body{font:16px/1.5 system-ui,sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem}table{border-collapse:collapse;width:100%}td,th{border-bottom:1px solid #ccc;padding:.3rem .5rem;text-align:left}.bad{color:#a00}.good{color:#070}"


def value(x: float | None, signed: bool = False) -> str:
    return "n/a" if x is None else f"{x:+.2f}" if signed else f"{x:.2f}"


def share(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.1%}"


def repeated(mean: float, stddev: float | None, n: int) -> str:
    """A score with its spread, if it was taken more than once."""
    return value(mean) if stddev is None or n <= 1 else f"{mean:.2f} ± {stddev:.2f} (n={n})"


def finding_message(f: dict[str, Any], cfg: dict[str, Any]) -> str:
    kind, delta = f["variant_type"], f["delta"]
    if kind == "gaming":
        text = f"superficial change raised the score by {delta:+.2f}" if f["violated"] else f"superficial change was not rewarded ({delta:+.2f})"
    elif kind == "degradation":
        text = f"damage lowered the score by {-delta:.2f}, less than the {cfg['min_degradation_drop']:.2f} required" if f["violated"] else f"damage lowered the score by {-delta:.2f}"
    else:
        text = f"equivalent wording moved the score by {abs(delta):.2f}, more than tolerated" if f["violated"] else f"equivalent wording moved the score by {abs(delta):.2f}"
    return text + (" (the 95% interval spans the threshold)" if f["uncertain"] else "")


def recommendations(s: dict[str, Any]) -> list[str]:
    out = []
    if (s["worst_gaming_gain"] or 0) > s["config"]["gaming_tolerance"]:
        out.append("Harden the grader against superficial edits before its scores are used: padding or flattery pays.")
    if s["weakest_degradation_drop"] is not None and s["weakest_degradation_drop"] < s["config"]["min_degradation_drop"]:
        out.append("Have the grader tie its score to the evidence: real damage goes unnoticed in part.")
    if (s["mean_paraphrase_delta"] or 0) > s["config"]["invariance_tolerance"]:
        out.append("Steady the grader against wording: equivalent texts get different scores.")
    if not s["violation_count"]:
        out.append("No threshold was crossed; keep these cases as a regression test.")
    if s["uncertainty_evaluable_count"] < s["variant_count"]:
        out.append("Repeat scores: for part of the variants the spread is unknown.")
    if s["uncertain_count"]:
        out.append("Raise the number of repeats where an interval spans its threshold.")
    for end, key in (("upper", "ceiling_limited_count"), ("lower", "floor_limited_count")):
        if s[key]:
            out.append(f"{s[key]} baselines lie so close to the {end} end of the scale that an effect could not show.")
    return out


def _summary_rows(s: dict[str, Any]) -> list[tuple[str, str]]:
    rows = [
        ("System", s["system_name"]), ("Risk", s["risk_level"] + (" (provisional)" if s["risk_is_provisional"] else "")), ("Cases", f"{s['case_count']} ({s['evidence_grade']})"), ("Variants", str(s["variant_count"])),
        ("Violations", f"{s['violation_count']} ({share(s['violation_rate'])})"), ("Uncertain", f"{s['uncertain_count']} of {s['uncertainty_evaluable_count']} evaluable"),
    ]
    rows += [(TITLES[m], value(s[m], signed=True)) for m in METRICS]
    if s["ceiling_limited_count"] is not None:
        rows.append(("Limited by the scale", f"{s['ceiling_limited_count']} at the top, {s['floor_limited_count']} at the bottom"))
    return rows + [("Origin of the variants", s["config"]["variant_origin"]), ("Provenance of the data", s["config"]["data_provenance"])]


def _cell(text: object) -> str:
    return str(text).replace("|", "\\|").replace("\n", " ")


def _markdown_table(head: Sequence[str], rows: Sequence[Sequence[object]]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(_cell, r)) + " |" for r in rows), ""]


def _html_table(head: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    body = "".join("<tr>" + "".join(f"<td>{escape(str(c))}</td>" for c in r) + "</tr>" for r in rows)
    return "<table><thead><tr>" + "".join(f"<th>{escape(h)}</th>" for h in head) + f"</tr></thead><tbody>{body}</tbody></table>"


def _page(title: str, body: str) -> str:
    policy = "default-src 'none'; style-src 'unsafe-inline'"
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}"><title>{escape(title)}</title><style>{STYLE}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>\n'


def _case_rows(case: dict[str, Any], cfg: dict[str, Any]) -> list[list[str]]:
    return [
        [v["variant_id"], v["variant_type"], repeated(v["variant_score"], v["variant_score_stddev"], v["variant_sample_count"]), value(v["delta"], True), "violated" if v["violated"] else "met", finding_message(v, cfg)]
        for v in case["variants"]
    ]


CASE_HEAD = ("Variant", "Type", "Score", "Change", "Threshold", "Finding")


def _case_title(c: dict[str, Any]) -> str:
    return f"{c['case_id']}: baseline {repeated(c['baseline_score'], c['baseline_score_stddev'], c['baseline_sample_count'])}, margin {value(c['validity_margin'], True)}"


def audit_markdown(result: dict[str, Any], models: dict[str, str] | None = None, day: date | None = None) -> str:
    out = ["# Validity audit", "", f"Date: {day or date.today()}", ""]
    if models:
        out += [f"Rewrites by {models['paraphrase']}; scores by {models['scoring']}.", ""]
    out += _markdown_table(("Figure", "Value"), _summary_rows(result))
    out += ["## What to do", "", *(f"- {r}" for r in recommendations(result)), "", "## Cases", ""]
    for c in result["cases"]:
        out += [f"### {_case_title(c)}", "", *_markdown_table(CASE_HEAD, _case_rows(c, result["config"]))]
    return "\n".join(out)


def audit_html(result: dict[str, Any], models: dict[str, str] | None = None, day: date | None = None) -> str:
    body = f"<p>Date: {escape(str(day or date.today()))}</p>"
    if models:
        body += f"<p>Rewrites by {escape(models['paraphrase'])}; scores by {escape(models['scoring'])}.</p>"
    body += _html_table(("Figure", "Value"), _summary_rows(result)) + "<h2>What to do</h2><ul>" + "".join(f"<li>{escape(r)}</li>" for r in recommendations(result)) + "</ul>"
    body += "".join(f"<h2>{escape(_case_title(c))}</h2>" + _html_table(CASE_HEAD, _case_rows(c, result["config"])) for c in result["cases"])
    return _page(f"Validity audit of {result['system_name']}", body)


def _comparison_rows(r: dict[str, Any]) -> list[tuple[str, str, str, str]]:
    rows = [("Risk", r["reference_risk"], r["candidate_risk"], f"{r['risk_rank_change']:+d}"), ("Violation rate", share(r["reference_violation_rate"]), share(r["candidate_violation_rate"]), f"{r['violation_rate_change']:+.1%}")]
    for m in METRICS:
        v = r["metric_values"][m]
        rows.append((TITLES[m], value(v["reference"], True), value(v["candidate"], True), value(v["change"], True)))
    return rows


def _change_rows(r: dict[str, Any]) -> list[list[str]]:
    return [[f["status"] + (" (provisional)" if f["change_is_provisional"] else ""), f["case_id"], f["variant_id"], value(f["reference_delta"], True), value(f["candidate_delta"], True), value(f["severity_change"], True)] for f in ordered(r["findings"])]


def ordered(findings: Sequence[dict[str, Any]]) -> list[dict[str, Any]]:
    return sorted(findings, key=lambda f: (STATUSES.index(f["status"]), -abs(f["severity_change"]), f["case_id"], f["variant_id"]))


CHANGE_HEAD = ("Status", "Case", "Variant", "Reference", "Candidate", "Severity")


def comparison_markdown(r: dict[str, Any]) -> str:
    out = ["# Comparison of two audits", "", f"{r['reference_system']} ({r['reference_model']}) against {r['candidate_system']} ({r['candidate_model']})", ""]
    out += _markdown_table(("Figure", "Reference", "Candidate", "Change"), _comparison_rows(r))
    out += _markdown_table(("Status", "Variants"), [(s, r[f"{s}_count"]) for s in STATUSES] + [("provisional", r["provisional_change_count"])])
    return "\n".join(out + ["## Changes", "", *_markdown_table(CHANGE_HEAD, _change_rows(r))])


def comparison_html(r: dict[str, Any]) -> str:
    body = f"<p>{escape(r['reference_system'])} ({escape(r['reference_model'])}) against {escape(r['candidate_system'])} ({escape(r['candidate_model'])})</p>"
    body += _html_table(("Figure", "Reference", "Candidate", "Change"), _comparison_rows(r)) + _html_table(("Status", "Variants"), [(s, r[f"{s}_count"]) for s in STATUSES])
    return _page("Comparison of two audits", body + "<h2>Changes</h2>" + _html_table(CHANGE_HEAD, _change_rows(r)))
