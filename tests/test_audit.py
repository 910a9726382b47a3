"""The audit against recorded figures and against plain Python over random cases."""

import math
import random
import statistics

import pytest

from probity.operators import audit, compare
from probity.operators.audit import T_CRITICAL, AuditConfig
from probity.refusals import Refusal

SCHEMA = "system_name string, case_id string, variant_id string, variant_type string, score double, score_stddev double, sample_count long, ordinal long"


def table(spark, rows):
    """Rows of (case_id, variant_id, variant_type, score[, stddev, count])."""
    full = [("s", *r[:4], *(r[4:] or (None, 1)), n) for n, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def case(name, baseline, gaming, degradation, paraphrase=None):
    scores = {"baseline": baseline, "gaming": gaming, "degradation": degradation, "paraphrase": paraphrase}
    return [(name, kind, kind, *(score if isinstance(score, tuple) else (score,))) for kind, score in scores.items() if score is not None]


def summary(spark, rows, cfg=None):
    cfg = cfg or AuditConfig()
    return audit.summary(audit.findings(audit.validate(table(spark, rows), cfg), cfg), cfg).first()


def test_a_sound_grader_is_low_risk(spark):
    s = summary(spark, case("c", 7.0, 6.9, 5.5, 7.1))
    assert (s["risk_level"], s["violation_count"], s["evidence_grade"], s["risk_is_provisional"]) == ("LOW", 0, "anecdotal", True)


@pytest.mark.parametrize("scores,drop,top,level", [((70.0, 73.0, 65.0), 4.0, 100.0, "HIGH"), ((3.0, 4.1, 1.5), 0.5, 5.0, "CRITICAL")])
def test_risk_follows_the_scale(spark, scores, drop, top, level):
    s = summary(spark, case("c", *scores), AuditConfig(min_degradation_drop=drop, score_min=0.0, score_max=top))
    assert s["risk_level"] == level


@pytest.mark.parametrize("rows,uncertain", [
    (case("c", (7.0, 0.2, 4), (7.3, 0.3, 4), (5.0, 0.2, 4)), 1),
    (case("c", (7.0, 0.18, 3), (7.4, 0.18, 3), (5.0, 0.0, 3)), 1),
    (case("c", (7.0, 0.0, 4), (7.0, 0.0, 4), (5.0, 0.0, 4)), 0),
])
def test_uncertain_findings(spark, rows, uncertain):
    s = summary(spark, rows)
    assert (s["uncertain_count"], s["uncertainty_evaluable_count"]) == (uncertain, 2)


@pytest.mark.parametrize("kind,score,violated", [("gaming", 6.5, False), ("gaming", 6.51, True), ("degradation", 5.0, False), ("degradation", 5.01, True), ("paraphrase", 6.5, False), ("paraphrase", 5.49, True)])
def test_thresholds_are_inclusive(spark, kind, score, violated):
    rows = [("c", "b", "baseline", 6.0), ("c", "pair_g", "gaming", 6.0), ("c", "pair_d", "degradation", 4.0), ("c", "probe", kind, score)]
    cfg = AuditConfig(gaming_tolerance=0.5, min_degradation_drop=1.0, invariance_tolerance=0.5)
    found = {r["variant_id"]: r["violated"] for r in audit.findings(table(spark, rows), cfg).collect()}
    assert found == {"pair_g": False, "pair_d": False, "probe": violated}


def test_headroom_is_strict_and_never_changes_the_risk(spark):
    rows = [r for n, (b, g, d) in enumerate([(10.0, 10.0, 8.0), (6.0, 6.5, 4.0), (9.0, 9.0, 7.0), (9.5, 9.5, 7.0), (0.0, 1.0, 0.0)]) for r in case(f"c{n}", b, g, d)]
    s = summary(spark, rows, AuditConfig(score_min=0.0, score_max=10.0))
    assert (s["ceiling_limited_count"], s["floor_limited_count"]) == (2, 1)
    assert summary(spark, rows)["ceiling_limited_count"] is None


def plain(rows, cfg):
    """The definitions in plain Python, one case after another."""
    found, margins = [], []
    for name in dict.fromkeys(r[0] for r in rows):
        own = [r for r in rows if r[0] == name]
        b = next(r for r in own if r[2] == "baseline")
        gains, drops = [], []
        for r in own:
            if r[2] == "baseline":
                continue
            delta = r[3] - b[3]
            contrast = {"gaming": delta - cfg.gaming_tolerance, "degradation": (b[3] - r[3]) - cfg.min_degradation_drop, "paraphrase": abs(delta) - cfg.invariance_tolerance}[r[2]]
            error = math.sqrt(b[4] ** 2 / b[5] + r[4] ** 2 / r[5]) if b[5] > 1 and r[5] > 1 else None
            uncertain = error is not None and error > 0 and abs(contrast) <= T_CRITICAL[min(min(b[5], r[5]) - 1, 30) - 1] * error
            found.append((name, r[1], contrast < 0 if r[2] == "degradation" else contrast > 0, uncertain))
            gains += [delta] * (r[2] == "gaming")
            drops += [-delta] * (r[2] == "degradation")
        margins.append(statistics.fmean(drops) - max(0.0, max(gains)))
    return found, statistics.fmean(margins)


@pytest.mark.parametrize("seed", range(4))
def test_random_cases_as_by_plain_python(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        kinds = ["baseline"] + ["gaming"] * rng.randint(1, 3) + ["degradation"] * rng.randint(1, 3) + ["paraphrase"] * rng.randint(0, 2)
        for n, kind in enumerate(kinds):
            count = rng.choice([1, 2, 3, 40])
            rows.append((f"c{c}", f"v{n}", kind, round(rng.uniform(0, 10), 2), None if count == 1 else round(rng.uniform(0, 2), 2), count))
    cfg = AuditConfig(invariance_tolerance=rng.choice([0.0, 0.5]), min_degradation_drop=rng.choice([0.5, 1.0]), gaming_tolerance=rng.choice([0.0, 0.25]))
    expected, margin = plain(rows, cfg)
    found = audit.findings(table(spark, rows), cfg)
    assert sorted((r["case_id"], r["variant_id"], r["violated"], r["uncertain"]) for r in found.collect()) == sorted(expected)
    s = audit.summary(found, cfg).first()
    assert (s["variant_count"], s["violation_count"], s["uncertain_count"]) == (len(expected), sum(e[2] for e in expected), sum(e[3] for e in expected))
    assert s["mean_validity_margin"] == pytest.approx(margin, abs=1e-9)


def test_an_audit_compared_with_itself_is_unchanged(spark):
    rows = [r for n in range(12) for r in case(f"c{n}", 6.0 + n / 10, 6.5, 5.0, 6.2)]
    found = audit.findings(table(spark, rows), AuditConfig())
    counts = {r["status"]: r["n"] for r in compare.status_counts(compare.findings(found, found)).collect()}
    assert counts == {"regression": 0, "improvement": 0, "worsened": 0, "improved": 0, "unchanged": 36}


@pytest.mark.parametrize("change", [dict(gaming_tolerance=-1.0), dict(invariance_tolerance=math.nan), dict(score_min=0.0), dict(score_min=5.0, score_max=5.0), dict(data_provenance="other"), dict(variant_origin="other")])
def test_configurations_that_are_refused(change):
    with pytest.raises(Refusal):
        AuditConfig(**change).validate()


@pytest.mark.parametrize("rows,why", [
    ([], "At least one"),
    (case("c", 7.0, 6.0, 5.0) + [("c", "gaming", "gaming", 6.0)], "more than once"),
    (case("c", 7.0, 6.0, None), "lacks paired variants: degradation"),
    ([("c", "g", "gaming", 6.0), ("c", "d", "degradation", 5.0)], "exactly one baseline; found 0"),
    (case("c", 7.0, (6.0, None, 3), 5.0), "missing for the repeated"),
    (case("c", 7.0, 11.0, 5.0), "outside"),
])
def test_scores_that_are_refused(spark, rows, why):
    with pytest.raises(Refusal, match=why):
        audit.validate(table(spark, rows), AuditConfig(score_min=0.0, score_max=10.0))
