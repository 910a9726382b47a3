"""The command line: audit, score, compare, generate, paraphrase, trajectory."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from probity.functions.languages import LANGUAGES
from probity.operators import audit, trajectory, variants
from probity.refusals import Refusal


def _names(raw: str | None) -> tuple[str, ...]:
    return tuple(p.strip() for p in (raw or "").split(",") if p.strip())


def _endpoint(p: argparse.ArgumentParser) -> None:
    p.add_argument("--model", required=True)
    p.add_argument("--base-url", required=True)
    p.add_argument("--api-key-env", default="OPENAI_API_KEY")
    p.add_argument("--temperature", type=float, default=0.0)
    p.add_argument("--timeout", type=float, default=60.0)
    p.add_argument("--max-retries", type=int, default=2)


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="probity", description="Validity audits of automatic graders, on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("audit", help="verdicts, margins and risk from scores")
    a.add_argument("--input", required=True)
    a.add_argument("--report", required=True)
    a.add_argument("--json", dest="json_output")
    a.add_argument("--html")
    a.add_argument("--manifest")
    a.add_argument("--generation-manifest")
    defaults = audit.AuditConfig()
    for name in ("invariance_tolerance", "min_degradation_drop", "gaming_tolerance"):
        a.add_argument("--" + name.replace("_", "-"), type=float, default=getattr(defaults, name))
    a.add_argument("--score-min", type=float)
    a.add_argument("--score-max", type=float)
    a.add_argument("--data-provenance", choices=audit.PROVENANCES, default="unspecified")
    a.add_argument("--variant-origin", choices=audit.ORIGINS, default="unspecified")

    s = commands.add_parser("score", help="score cases with a model, repeatedly and resumably")
    for name in ("--input", "--output", "--rubric-file", "--system-name"):
        s.add_argument(name, required=True)
    _endpoint(s)
    s.add_argument("--score-min", type=float, default=0.0)
    s.add_argument("--score-max", type=float, default=10.0)
    s.add_argument("--repeats", type=int, default=1)
    s.add_argument("--manifest")
    s.add_argument("--raw-output")
    s.add_argument("--checkpoint")
    s.add_argument("--resume", action="store_true")

    c = commands.add_parser("compare", help="two audits of the same cases")
    for name in ("--reference", "--candidate", "--report"):
        c.add_argument(name, required=True)
    c.add_argument("--json", dest="json_output")
    c.add_argument("--html")

    for name, families in (("generate", variants), ("trajectory", trajectory)):
        g = commands.add_parser(name, help="variants of annotated " + ("texts" if name == "generate" else "trajectories"))
        g.add_argument("--input", required=True)
        g.add_argument("--output")
        g.add_argument("--gaming", default=",".join(families.GAMING))
        g.add_argument("--degradation", default=",".join(families.DEGRADATION))
        g.add_argument("--paraphrase", default="" if name == "generate" else ",".join(families.PARAPHRASE))
        g.add_argument("--seed", type=int, default=0)
        g.add_argument("--draws", choices=("seeded", "hashed"), default="seeded", help="one generator over all cases in order, or a hash of each case, for large sets")
        g.add_argument("--language", choices=sorted(LANGUAGES), default="chinese")
        g.add_argument("--manifest")
        g.add_argument("--append", action="store_true")
        g.add_argument("--show-sentences" if name == "generate" else "--show-steps", dest="show", action="store_true")
        if name == "generate":
            g.add_argument("--paraphrase-review")
            g.add_argument("--paraphrase-manifest")

    p = commands.add_parser("paraphrase", help="drafts of rewrites, for people to approve")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--language", choices=sorted(LANGUAGES), default="chinese")
    p.add_argument("--manifest")
    _endpoint(p)
    return parser


def _client(args: argparse.Namespace, low: float = 0.0, high: float = 10.0):
    from probity.sources.provider import ChatClient, Endpoint, key_from_environment

    # the key is read where the call is made, so it is in no plan
    def make() -> ChatClient:
        key = key_from_environment(args.api_key_env, args.base_url)
        return ChatClient(Endpoint(args.base_url, args.model, key, low, high, args.temperature, args.timeout, args.max_retries))

    make()
    return make


def run(args: argparse.Namespace, spark=None) -> list[str]:
    """Carry a command out; the lines that it prints."""
    from probity.plans import runs
    from probity.session import local_session

    spark = spark or local_session()
    if args.command == "audit":
        names = ("invariance_tolerance", "min_degradation_drop", "gaming_tolerance", "score_min", "score_max", "data_provenance", "variant_origin")
        cfg = audit.AuditConfig(**{n: getattr(args, n) for n in names}).validate()
        r = runs.run_audit(spark, args.input, cfg, report=args.report, json_output=args.json_output, html=args.html, manifest=args.manifest, generation_manifest=args.generation_manifest)
        return [f"Report: {args.report}", f"Risk {r['risk_level']}{' (provisional)' if r['risk_is_provisional'] else ''}, violation rate {r['violation_rate']:.1%}"]
    if args.command == "compare":
        r = runs.run_compare(spark, args.reference, args.candidate, report=args.report, json_output=args.json_output, html=args.html)
        return [f"Report: {args.report}", f"Risk {r['reference_risk']} to {r['candidate_risk']}; {r['regression_count']} regressions, {r['improvement_count']} improvements"]
    if args.command in ("generate", "trajectory"):
        if args.show:
            return runs.show_sentences(spark, args.input, args.language) if args.command == "generate" else runs.show_steps(spark, args.input)
        if not args.output:
            raise Refusal("--output is required.")
        common = {"language": args.language, "seed": args.seed, "gaming": _names(args.gaming), "degradation": _names(args.degradation), "paraphrases": _names(args.paraphrase), "manifest": args.manifest, "append": args.append, "draws": args.draws}
        if args.command == "generate":
            r = runs.run_generate(spark, args.input, args.output, review=args.paraphrase_review, review_manifest=args.paraphrase_manifest, **common)
        else:
            r = runs.run_trajectory(spark, args.input, args.output, **common)
        return [f"Cases: {args.output}", f"{r['row_count']} rows from {r['case_count']} baselines; origin {r['set_origin']}. Review them before use."]
    if args.command == "paraphrase":
        r = runs.run_paraphrase(spark, args.input, args.output, _client(args), model=args.model, base_url=args.base_url, language=args.language, temperature=args.temperature, manifest=args.manifest)
        return [f"Review file: {args.output}", f"{r['draft_count']} drafts, {r['blocked_count']} blocked"]
    if args.resume and not args.checkpoint:
        raise Refusal("--resume needs --checkpoint.")
    r = runs.run_score(
        spark, args.input, args.output, args.rubric_file, _client(args, args.score_min, args.score_max), manifest=args.manifest, raw_output=args.raw_output, system_name=args.system_name, provider="openai-compatible",
        model=args.model, base_url=args.base_url, score_min=args.score_min, score_max=args.score_max, temperature=args.temperature, repeats=args.repeats, checkpoint=args.checkpoint, resume=args.resume,
    )
    warning = ["Repeated scores without --raw-output: single samples are not kept."] if args.repeats > 1 and not args.raw_output else []
    return [*warning, f"Scores: {args.output}", f"{r['record_count']} records; {r['new_sample_count']} new samples, {r['resumed_sample_count']} resumed"]


def main(argv: Sequence[str] | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    try:
        print("\n".join(run(args)))
    except Refusal as error:
        parser.error(str(error))
    return 0


if __name__ == "__main__":
    sys.exit(main())
