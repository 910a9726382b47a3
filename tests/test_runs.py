"""Whole runs through the command line: golden figures, the chain of hashes, resuming, refusals."""

import csv
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from probity import cli
from probity.functions import reports
from probity.functions.fingerprint import stable_hash
from probity.operators.scoring import ProviderScore
from probity.plans import runs
from probity.refusals import Refusal
from probity.sources import csv_tables

DEMO = {"essay_001": (6.0, 7.2, 6.4, 5.8), "essay_002": (7.0, 7.8, 6.5, 7.6), "essay_003": (5.5, 7.0, 4.0, 5.2)}
KINDS = ("baseline", "gaming", "degradation", "paraphrase")


def table(path, header, rows):
    path.write_text(runs.csv_text(header, rows), encoding="utf-8")
    return str(path)


@pytest.fixture()
def demo(tmp_path):
    rows = [("Synthetic grader", case, kind, kind, score, "") for case, scores in DEMO.items() for kind, score in zip(KINDS, scores)]
    return table(tmp_path / "scores.csv", ("system_name", "case_id", "variant_id", "variant_type", "score", "notes"), rows)


def command(spark, *argv):
    return cli.run(cli.build_parser().parse_args([str(a) for a in argv]), spark)


def test_demo_audit_has_the_published_figures(spark, demo, tmp_path):
    lines = command(spark, "audit", "--input", demo, "--report", tmp_path / "r.md", "--json", tmp_path / "r.json", "--html", tmp_path / "r.html")
    r = json.loads((tmp_path / "r.json").read_text())
    assert (r["risk_level"], r["case_count"], r["variant_count"], r["violation_count"]) == ("HIGH", 3, 9, 6)
    assert r["risk_is_provisional"] and r["uncertain_count"] == r["uncertainty_evaluable_count"] == 0
    for name, figure in (("mean_gaming_gain", 1.1667), ("worst_gaming_gain", 1.5), ("mean_degradation_drop", 0.5333), ("weakest_degradation_drop", -0.4), ("mean_paraphrase_delta", 0.3667), ("mean_validity_margin", -0.6333)):
        assert r[name] == pytest.approx(figure, abs=5e-5)
    assert [c["validity_margin"] for c in r["cases"]] == pytest.approx([-1.6, -0.3, 0.0])
    assert "66.7%" in lines[1] and "Risk" in (tmp_path / "r.md").read_text()
    assert "default-src 'none'" in (tmp_path / "r.html").read_text()


def scores_of(path, values, system, manifest_model=None, **more):
    rows = [(system, "c1", kind, kind, v) for kind, v in zip(KINDS, values)]
    out = table(path, ("system_name", "case_id", "variant_id", "variant_type", "score"), rows)
    if manifest_model:
        m = {"record_count": 4, "model": manifest_model, "repeats": 3, "temperature": 0.2, "input_sha256": "a" * 64, "rubric_sha256": "B" * 64} | more
        path.with_suffix(".manifest.json").write_text(json.dumps(m))
    return out


def test_compare(spark, tmp_path):
    for name, values in (("ref", (7.0, 7.0, 5.0, 7.0)), ("cand", (7.0, 7.8, 6.5, 7.2))):
        scores_of(tmp_path / f"{name}.csv", values, name, f"model-{name}")
        command(spark, "audit", "--input", tmp_path / f"{name}.csv", "--report", tmp_path / "x.md", "--json", tmp_path / f"{name}.json")
    command(spark, "compare", "--reference", tmp_path / "ref.json", "--candidate", tmp_path / "cand.json", "--report", tmp_path / "c.md", "--json", tmp_path / "c.json", "--html", tmp_path / "c.html")
    r = json.loads((tmp_path / "c.json").read_text())
    assert (r["reference_risk"], r["candidate_risk"], r["risk_rank_change"]) == ("LOW", "HIGH", 2)
    assert (r["regression_count"], r["worsened_count"], r["provisional_change_count"]) == (2, 1, 3)
    other = json.loads((tmp_path / "cand.json").read_text())
    for change, why in (({"violation_count": 1}, "does not follow"), ({"schema_version": 2}, "schema_version"), ({"comparison_context": None}, "comparison_context"), ({"risk_level": "NONE"}, "risk_level"),
                        ({"comparison_context": other["comparison_context"] | {"temperature": 0.3}}, "temperature"), ({"config": other["config"] | {"gaming_tolerance": 0.1}}, "gaming_tolerance")):
        with pytest.raises(Refusal, match=why):
            runs.compare_results(spark, json.loads((tmp_path / "ref.json").read_text()), other | change)
    moved = json.loads((tmp_path / "cand.json").read_text())
    moved["cases"][0]["variants"][0]["variant_id"] = "other"
    with pytest.raises(Refusal, match="missing in"):
        runs.compare_results(spark, json.loads((tmp_path / "ref.json").read_text()), moved)


BASELINES = [("c1", "第一句说明观点。第二句给出证据！第三句因此得出结论。", "2", "备注"), ("c2", "但是甲方反对。乙方举例说明；丙方总结。", "1,2", "")]


class Echo:
    """A scorer that reads its score from the length of the text, and fails after ``limit`` calls."""

    calls = 0

    def __init__(self, limit=None):
        self.limit = limit

    def score(self, text, rubric):
        if self.limit is not None and Echo.calls >= self.limit:
            raise RuntimeError("interrupted")
        Echo.calls += 1
        return ProviderScore(float(len(text) % 10), "because\nof length", "{}", None, 10, 2)


SETTINGS = dict(system_name="grader", provider="p", model="grader-1", base_url="http://localhost", score_min=0.0, score_max=10.0, temperature=0.0)


def test_generate_score_audit_chain(spark, tmp_path):
    source = table(tmp_path / "b.csv", ("case_id", "text", "evidence_sentences", "notes"), BASELINES)
    cases = tmp_path / "cases.csv"
    command(spark, "generate", "--input", source, "--output", cases, "--seed", 3)
    rows = list(csv.DictReader(cases.open(encoding="utf-8")))
    assert len(rows) == 10 and rows[0]["notes"] == "generated=baseline | source_note=备注"
    m = json.loads((tmp_path / "cases.manifest.json").read_text())
    assert m["output_sha256"] == stable_hash(rows) and m["set_origin"] == "machine-generated" and m["row_count"] == 10
    assert {r["case_id"]: r["text"] for r in rows if r["variant_id"] == "degradation_remove_evidence"} == {"c1": "第一句说明观点。第三句因此得出结论。", "c2": "丙方总结。"}
    again = tmp_path / "again.csv"
    command(spark, "generate", "--input", source, "--output", again, "--seed", 3)
    assert again.read_bytes() == cases.read_bytes()
    with pytest.raises(Refusal, match="exists already"):
        command(spark, "generate", "--input", source, "--output", cases)
    (tmp_path / "rubric.md").write_text("grade it")
    doc = runs.run_score(spark, str(cases), str(tmp_path / "s.csv"), str(tmp_path / "rubric.md"), Echo, repeats=2, raw_output=str(tmp_path / "raw.jsonl"), **SETTINGS)
    assert doc["input_sha256"] == m["output_sha256"] and (doc["record_count"], doc["sample_count"], doc["prompt_tokens_total"]) == (10, 20, 200)
    assert len((tmp_path / "raw.jsonl").read_text().splitlines()) == 20
    audit = ["audit", "--input", tmp_path / "s.csv", "--report", tmp_path / "a.md", "--json", tmp_path / "a.json", "--variant-origin", "machine-generated"]
    command(spark, *audit, "--generation-manifest", tmp_path / "cases.manifest.json")
    assert json.loads((tmp_path / "a.json").read_text())["comparison_context"]["generation_sha256"]
    with pytest.raises(Refusal, match="must be shown"):
        command(spark, *audit)
    (tmp_path / "cases.manifest.json").write_text(json.dumps(m | {"output_sha256": "0" * 64}))
    with pytest.raises(Refusal, match="changed afterwards"):
        command(spark, *audit, "--generation-manifest", tmp_path / "cases.manifest.json")


def test_append_and_ratify(spark, tmp_path):
    source = table(tmp_path / "b.csv", ("case_id", "text", "evidence_sentences", "notes"), BASELINES)
    cases = tmp_path / "cases.csv"
    command(spark, "generate", "--input", source, "--output", cases)
    rows = list(csv.DictReader(cases.open(encoding="utf-8")))
    kept = [r for r in rows if not (r["case_id"] == "c2" and r["variant_id"] == "gaming_rubric_flattery")]
    kept[1]["text"] += "改"
    kept.append({"case_id": "c1", "variant_id": "by_hand", "variant_type": "gaming", "text": "手写", "notes": ""})
    table(cases, rows[0].keys(), [r.values() for r in kept])
    review = table(tmp_path / "review.csv", csv_tables.REVIEW_ORDER, [("c1", stable_hash(BASELINES[0][1]), "", "换一种说法。", "approved", "", "", "好"), ("c2", "f" * 64, "", "x", "pending", "", "", "")])
    with pytest.raises(Refusal, match="Drafting manifest"):
        command(spark, "generate", "--input", source, "--output", cases, "--append", "--paraphrase-review", review)
    (tmp_path / "review.manifest.json").write_text(json.dumps({"paraphrase_model": "writer"}))
    command(spark, "generate", "--input", source, "--output", cases, "--append", "--paraphrase-review", review)
    m = json.loads((tmp_path / "cases.manifest.json").read_text())
    assert m["set_origin"] == "mixed" and m["paraphrase_model"] == "writer" and m["paraphrase_review"] == {"approved": 1, "blocked": 0, "pending": 1, "rejected": 0}
    assert m["merge"]["appended"] == [["c2", "gaming_rubric_flattery"]] and m["merge"]["foreign"] == [["c1", "by_hand"]] and len(m["merge"]["edited"]) == 1
    assert [r["variant_id"] for r in csv.DictReader(cases.open(encoding="utf-8"))][-2:] == ["by_hand", "paraphrase_ratified"]
    table(tmp_path / "review.csv", csv_tables.REVIEW_ORDER, [("c1", "e" * 64, "", "x", "approved", "", "", "")])
    with pytest.raises(Refusal, match="edited after"):
        command(spark, "generate", "--input", source, "--output", cases, "--append", "--paraphrase-review", review)


def test_resume_calls_only_what_is_missing(spark, tmp_path):
    rows = [(f"c{n}", kind, kind, f"text {n} {kind}", "") for n in (1,) for kind in KINDS[:3]]
    cases = csv_tables.read_cases(spark, table(tmp_path / "cases.csv", ("case_id", "variant_id", "variant_type", "text", "notes"), rows)).cache()
    path, run = str(tmp_path / "log.jsonl"), lambda scorer, **k: runs.score_cases(spark, cases, scorer, "rubric", repeats=2, checkpoint=path, **SETTINGS | k)
    Echo.calls = 0
    with pytest.raises(RuntimeError):
        run(lambda: Echo(3))
    assert len((tmp_path / "log.jsonl").read_text().splitlines()) == 4
    with pytest.raises(Refusal, match="exists already"):
        run(Echo)
    with pytest.raises(Refusal, match="temperature"):
        run(Echo, resume=True, temperature=1.0)
    with (tmp_path / "log.jsonl").open("ab") as f:
        f.write(b'{"type": "sam')
    Echo.calls = 0
    _, samples, m = run(Echo, resume=True)
    assert Echo.calls == 3 and m["checkpoint_repaired_truncated_tail"] and (m["resumed_sample_count"], m["new_sample_count"], m["prompt_tokens_total"]) == (3, 3, 60)
    assert samples.count() == 6
    Echo.calls = 0
    records, _, m = run(Echo, resume=True)
    assert Echo.calls == 0 and m["new_sample_count"] == 0 and records.first()["notes"].startswith("sample_1_reason=because of")
    lines = (tmp_path / "log.jsonl").read_text().splitlines()
    for bad, why in ((lines[:2] + ["nonsense", lines[2]], "malformed"), (lines + [lines[-1]], "twice"), ([lines[1]], "header"), (lines[:1] + ['{"type": "sample"}'], "case_id"), (lines[:1] + [lines[1].replace('"sample_index": 1', '"sample_index": 9')], "outside")):
        (tmp_path / "log.jsonl").write_text("\n".join(bad) + "\n")
        with pytest.raises(Refusal, match=why):
            run(Echo, resume=True)


def trajectory_line(**change):
    step = lambda tool, result: {"tool": tool, "args": {"b": 1, "a": "é"}, "result": result}
    row = {"case_id": "t1", "task": "find it", "steps": [step("search", "ten hits"), step("read", "the answer"), step("time", "noon")], "final_answer": "42", "load_bearing_steps": [2], "independent_steps": [[1, 3]]}
    return json.dumps(row | change, ensure_ascii=False)


def test_trajectories(spark, tmp_path):
    source, cases = tmp_path / "t.jsonl", tmp_path / "cases.csv"
    source.write_text("\n" + trajectory_line() + "\n")
    command(spark, "trajectory", "--input", source, "--output", cases, "--language", "english")
    rows = {r["variant_id"]: r for r in csv.DictReader(cases.open(encoding="utf-8"))}
    assert len(rows) == 6 and 'Arguments: {"a": "é", "b": 1}' in rows["baseline"]["text"]
    assert "the answer" not in rows["degradation_remove_load_bearing_step"]["text"] and "42" in rows["degradation_remove_load_bearing_step"]["text"]
    assert "(no result)" in rows["degradation_hollow_evidence"]["text"]
    moved = rows["paraphrase_reorder_independent_steps"]["text"]
    assert moved.index("time") < moved.index("read") < moved.index("search")
    assert rows["gaming_redundant_tool_calls"]["text"].count("Step ") == 5
    assert command(spark, "trajectory", "--input", source, "--show-steps")[0] == "[t1] find it"


@pytest.mark.parametrize("change,why", [
    ({"steps": []}, "at least one step"), ({"steps": "x"}, "list"), ({"steps": [{"tool": " "}]}, "name a tool"), ({"steps": [{"tool": "a", "result": 1}]}, "must be text"), ({"load_bearing_steps": []}, "never inferred"),
    ({"load_bearing_steps": [True]}, "whole numbers"), ({"load_bearing_steps": [1, 1]}, "repeats"), ({"load_bearing_steps": [9]}, "outside"), ({"load_bearing_steps": [1, 2, 3]}, "all steps"), ({"independent_steps": [[1]]}, "two members"),
    ({"independent_steps": [[1, 2], [2, 3]]}, "more than one"), ({"independent_steps": {}}, "list of lists"), ({"task": ""}, "task"), ({"case_id": 3}, "case_id"),
])
def test_trajectory_refusals(spark, tmp_path, change, why):
    (tmp_path / "t.jsonl").write_text(trajectory_line(**change))
    with pytest.raises(Refusal, match=why):
        command(spark, "trajectory", "--input", tmp_path / "t.jsonl", "--output", tmp_path / "o.csv")


SCORE = ("system_name", "case_id", "variant_id", "variant_type", "score", "score_stddev", "sample_count")


@pytest.mark.parametrize("cells,why", [
    ({"variant_type": "other"}, "Row 3.*not one of"), ({"score": "x"}, "must be a number"), ({"score": "nan"}, "finite"), ({"score": "1d"}, "must be a number"), ({"score_stddev": "-1", "sample_count": "2"}, "not negative"), ({"sample_count": "1.5"}, "whole number"),
    ({"sample_count": "0"}, "at least 1"), ({"sample_count": "2"}, "is needed"), ({"score_stddev": "0.5"}, "empty or 0"), ({"case_id": " "}, "empty required values: case_id"), ({"variant_id": "baseline"}, "more than once"), ({"system_name": "b"}, "exactly one system_name"),
    ({"variant_type": "paraphrase"}, "lacks paired variants: gaming"), ({"variant_type": "baseline"}, "exactly one baseline"),
])
def test_score_refusals(spark, tmp_path, cells, why):
    rows = [dict(zip(SCORE, ("a", "c", kind, kind, "5", "", ""))) for kind in KINDS]
    rows[1] |= cells
    path = table(tmp_path / "s.csv", SCORE, [r.values() for r in rows])
    with pytest.raises(Refusal, match=why):
        command(spark, "audit", "--input", path, "--report", tmp_path / "r.md")


@pytest.mark.parametrize("cells,why", [
    (("c1", "一。二。", "1,2", ""), "not every sentence"), (("c1", "一。", "1", ""), "two sentences"), (("c1", "一。二。", "3", ""), "names sentence 3 of 2"), (("c1", "一。二。", "x", ""), "positive whole"), (("c1", "一。二。三。", "1,1", ""), "repeats"),
    (("c1", "一。二。", "", ""), "must not be empty"), (("c1", "一。二。", "1", "3"), "sentence_count says 3"), (("", "一。二。", "1", ""), "empty required"),
])
def test_baseline_refusals(spark, tmp_path, cells, why):
    path = table(tmp_path / "b.csv", ("case_id", "text", "evidence_sentences", "sentence_count"), [cells])
    with pytest.raises(Refusal, match=why):
        csv_tables.read_baselines(spark, path)


def test_missing_files_and_columns(spark, tmp_path):
    with pytest.raises(Refusal, match="does not exist"):
        csv_tables.read_scores(spark, str(tmp_path / "none.csv"))
    with pytest.raises(Refusal, match="missing columns: score, system_name"):
        csv_tables.read_scores(spark, table(tmp_path / "x.csv", ("case_id", "variant_id", "variant_type"), [("a", "b", "c")]))
    with pytest.raises(Refusal, match="no records"):
        csv_tables.read_scores(spark, table(tmp_path / "y.csv", SCORE, []))


def test_a_folder_of_parts_is_read_back_without_loss(spark, tmp_path):
    texts = ['with "quotes", commas', "two\nlines", "ünï 漢字", "back\\slash", "x"]
    rows = [(f"c{n}", kind, kind, t if kind == "baseline" else f"{kind} {t}", "") for n, t in enumerate(texts) for kind in KINDS]
    df = spark.createDataFrame(rows, "case_id string, variant_id string, variant_type string, text string, notes string")
    csv_tables.write_table(df.repartition(3), str(tmp_path / "parts"))
    found = csv_tables.read_cases(spark, str(tmp_path / "parts"))
    assert sorted(tuple(r)[:5] for r in found.collect()) == sorted(rows)


class Handler(BaseHTTPRequestHandler):
    script: list = []
    seen: list = []

    def do_POST(self):
        Handler.seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
        status, body = Handler.script.pop(0) if len(Handler.script) > 1 else Handler.script[0]
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture()
def server():
    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    Handler.seen = []
    yield f"http://127.0.0.1:{http.server_port}/v1"
    http.shutdown()


def reply(content, **more):
    return 200, json.dumps({"id": 7, "choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": 5, "completion_tokens": "x"}} | more)


def test_transport(server, monkeypatch):
    from probity.sources import provider

    monkeypatch.setattr(provider.time, "sleep", lambda s: None)
    client = provider.ChatClient(provider.Endpoint(server, "m", "secret"))
    assert "secret" not in repr(client.endpoint)
    Handler.script = [(503, "busy"), (429, "busy"), reply('```json\n{"score": 7.5, "reason": " fine "}\n```')]
    found = client.score("text", "rubric")
    assert (found.score, found.reason, found.response_id, found.prompt_tokens, found.completion_tokens) == (7.5, "fine", "7", 5, None) and len(Handler.seen) == 3
    for script, why in (([(400, "bad" * 400)], "HTTP error 400"), ([(500, "no")], "HTTP error 500"), ([(200, "<html>")], "not JSON"), ([(200, "{}")], "no message"), ([reply("no object")], "no JSON object"), ([reply('{"score": true}')], "numeric score"), ([reply('{"score": 11}')], "outside"), ([reply('{"score": 1, "reason": 2}')], "must be text"), ([reply('say {"score": } ok')], "malformed")):
        Handler.script = script
        with pytest.raises(provider.ProviderError, match=why):
            client.score("text", "rubric")
    Handler.script = [reply([{"text": 'so {"score": '}, {"text": "3} it is"}])]
    assert client.score("t", "r").score == 3.0


@pytest.mark.parametrize("change,why", [
    ({"base_url": "ftp://x"}, "absolute"), ({"base_url": "http://u:p@localhost"}, "credentials"), ({"base_url": "https://x?q=1"}, "query"), ({"base_url": "http://example.com"}, "https"), ({"model": " "}, "model"), ({"temperature": 3}, "between 0 and 2"), ({"max_retries": -1}, "max_retries"), ({"score_max": 0}, "greater"), ({"timeout_seconds": 0}, "positive"),
])
def test_endpoint_refusals(change, why):
    from probity.sources.provider import Endpoint

    with pytest.raises(Refusal, match=why):
        Endpoint(**({"base_url": "https://x", "model": "m", "api_key": "k"} | change)).validate()


def test_drafting_and_scoring_over_http(spark, tmp_path, server):
    source = table(tmp_path / "b.csv", ("case_id", "text", "evidence_sentences"), [b[:3] for b in BASELINES])
    Handler.script = [reply("换个说法：观点、证据与结论都在这里。")]
    command(spark, "paraphrase", "--input", source, "--output", tmp_path / "review.csv", "--model", "writer", "--base-url", server)
    rows = list(csv.DictReader((tmp_path / "review.csv").open(encoding="utf-8")))
    assert [r["status"] for r in rows] == ["pending", "pending"] and rows[0]["baseline_sha256"] == stable_hash(BASELINES[0][1])
    assert len(Handler.seen) == 2
    with pytest.raises(Refusal, match="exists already"):
        command(spark, "paraphrase", "--input", source, "--output", tmp_path / "review.csv", "--model", "writer", "--base-url", server)
    command(spark, "generate", "--input", source, "--output", tmp_path / "cases.csv")
    (tmp_path / "rubric.md").write_text("grade it")
    Handler.script = [reply('{"score": 5, "reason": "ok"}')]
    lines = command(spark, "score", "--input", tmp_path / "cases.csv", "--output", tmp_path / "s.csv", "--rubric-file", tmp_path / "rubric.md", "--model", "grader", "--base-url", server, "--system-name", "g", "--checkpoint", tmp_path / "log.jsonl")
    assert "10 new samples" in lines[-1] and len(Handler.seen) == 12
    command(spark, "score", "--input", tmp_path / "cases.csv", "--output", tmp_path / "s.csv", "--rubric-file", tmp_path / "rubric.md", "--model", "grader", "--base-url", server, "--system-name", "g")
    assert len(Handler.seen) == 22
    assert not any(w in json.dumps(Handler.seen[-1]) for w in ("gaming_", "degradation_"))


def test_stream_scores_each_sample_once(spark, tmp_path):
    from probity.operators import scoring
    from probity.streaming.checkpoint import read_state, score_stream

    cases = spark.createDataFrame([("c", k, k, f"text {k}") for k in KINDS], "case_id string, variant_id string, variant_type string, text string")
    planned = str(tmp_path / "planned")
    scoring.plan(cases, 3).repartition(3).write.parquet(planned)
    for _ in range(2):
        score_stream(spark, planned, str(tmp_path / "state"), str(tmp_path / "progress"), lambda: Echo(), "rubric", 0.0, 10.0)
    state = read_state(spark, str(tmp_path / "state"))
    assert state.count() == 12 and scoring.repeated(state).count() == 0 and scoring.missing(scoring.plan(cases, 3), state).count() == 0


def test_reports_escape_what_they_show(spark, tmp_path):
    rows = [("<script>x</script>", "c|1", kind, kind, v) for kind, v in zip(KINDS, (5, 6, 4, 5))]
    path = table(tmp_path / "s.csv", ("system_name", "case_id", "variant_id", "variant_type", "score"), rows)
    command(spark, "audit", "--input", path, "--report", tmp_path / "r.md", "--html", tmp_path / "r.html")
    page = (tmp_path / "r.html").read_text()
    assert "<script>" not in page and "&lt;script&gt;" in page
    assert reports.value(None) == "n/a" and reports.value(0.125) == "0.12" and reports.repeated(1.0, 0.5, 3) == "1.00 ± 0.50 (n=3)"


def test_logs_heal_and_refuse(tmp_path):
    """A sample that only lacks its line end counts; a torn one goes once all else is checked; blank lines and changed files are refused."""
    from probity.streaming.checkpoint import Log

    path, context = tmp_path / "log.jsonl", {"model": "m", "seed": 1}
    sample = {"case_id": "c", "variant_id": "v", "variant_type": "gaming", "sample_index": 1, "input_sha256": "a" * 64, "score": 1.5, "reason": "", "raw_content": "{}", "response_id": None, "prompt_tokens": 3, "completion_tokens": None, "latency_seconds": 0.5}
    Log.create(path, context).append(sample)
    path.write_bytes(path.read_bytes().rstrip())
    log = Log.load(path, context)
    assert log.torn_at is None and list(log.samples) == [("c", "v", 1)]
    log.append(sample | {"sample_index": 2})
    assert len(Log.load(path, context).samples) == 2
    whole = path.read_bytes()
    for tail in (b'{"type": "sam', b"  ", b"\xff\xfe"):
        path.write_bytes(whole + tail)
        log = Log.load(path, context)
        assert path.read_bytes() == whole + tail and log.repair() and path.read_bytes() == whole and not log.repair()
    path.write_bytes(whole + b"{")
    log = Log.load(path, context)
    path.write_bytes(whole + b"{{")
    with pytest.raises(Refusal, match="changed"):
        log.repair()
    for raw, why in ((whole + b"\n", "blank"), (whole + b"{\n", "malformed"), (b"", "empty"), (whole.replace(b'"score": 1.5', b'"score": true'), "score"), (whole.replace(b'"prompt_tokens": 3', b'"prompt_tokens": -3'), "prompt_tokens"), (whole.replace(b"gaming", b"other"), "variant_type")):
        path.write_bytes(raw)
        with pytest.raises(Refusal, match=why):
            Log.load(path, context)
    path.write_bytes(whole)
    with pytest.raises(Refusal, match="seed"):
        Log.load(path, context | {"seed": 2})
    path.unlink()
    for act in (lambda: Log.load(path, context), lambda: log.append(sample)):
        with pytest.raises(Refusal, match="does not exist"):
            act()


def test_replies_are_read_strictly():
    from probity.sources.provider import ProviderError, parse_score, token_count

    for text in ('{"score": "4", "reason": " r "}', '```\n{"score": 4, "reason": "r"}\n```', 'Well: {"score": 4.0, "reason": "r"} as said', '```json\n{"score": 4, "reason": "r"}'):
        assert parse_score(text, 0, 10) == (4.0, "r")
    for text, why in (("", "no JSON object"), ("[1]", "JSON object"), ('"x"', "JSON object"), ('{"score": 1} {"score": 2}', "malformed"), ('{"score": NaN}', "finite"), ('{"reason": "x"}', "numeric"), ('```\n[{"score": 1}]\n```', "JSON object"), ("} {", "no JSON object")):
        with pytest.raises(ProviderError, match=why):
            parse_score(text, 0, 10)
    assert [token_count(x) for x in (None, "12", 3.9, "x", [], float("inf"))] == [None, 12, 3, None, None, None]


def test_hashed_draws_and_own_strategies(spark, tmp_path):
    """Picks by hash need no list of cases; a registered strategy is used like a built-in one."""
    source = table(tmp_path / "b.csv", ("case_id", "text", "evidence_sentences", "notes"), BASELINES)
    command(spark, "generate", "--input", source, "--output", tmp_path / "cases.csv", "--draws", "hashed")
    m = json.loads((tmp_path / "cases.manifest.json").read_text())
    assert m["draws"] == "hashed" and (m["row_count"], m["case_count"]) == (10, 2)
    from probity.operators import variants

    def shouting(language):
        return variants.Built(F.concat("text", F.lit("！")), F.array(F.lit("！")), F.lit("marks=1"), [("added nothing", F.col("produced") == F.col("text"))])

    variants.register("shouting", variants.Strategy("gaming", shouting))
    try:
        command(spark, "generate", "--input", source, "--output", tmp_path / "own.csv", "--gaming", "shouting")
        rows = list(csv.DictReader((tmp_path / "own.csv").open(encoding="utf-8")))
        assert [r["text"] for r in rows if r["variant_id"] == "gaming_shouting"] == [b[1] + "！" for b in BASELINES]
        for name, family in (("rubric_flattery", "gaming"), ("x", "other")):
            with pytest.raises(Refusal):
                variants.register(name, variants.Strategy(family, shouting))
    finally:
        variants._OWN.clear()
