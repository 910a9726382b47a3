"""DuckDB SQL for the registered queries. It restates the definitions; it does not call the engine."""

from __future__ import annotations

from probity.functions.languages import BOUNDARIES, CHINESE, ENGLISH, Labels, Language
from probity.operators.audit import T_CRITICAL
from probity.plans.adapters import CHINESE_FROM, CHINESE_TO

SEED, REPEATS = 7, 5
_T = "[" + ", ".join(f"{t}::double" for t in T_CRITICAL) + "]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _json(text: str) -> str:
    """A text as a JSON string."""
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    out = f"replace(replace({text}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
    for code in range(1, 32):
        out = f"replace({out}, chr({code}), chr(92) || '{short.get(code, f'u{code:04x}')}')"
    return f"chr(34) || {out} || chr(34)"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


SCORES = """
ranked as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rk from lineitem),
scores as (select l_orderkey::varchar as case_id, 'v' || rk as variant_id,
  case rk when 1 then 'baseline' when 2 then 'gaming' when 3 then 'degradation' else 'paraphrase' end as variant_type,
  l_quantity / 5.0::double as score, case when l_linenumber > 1 then l_discount * 10.0::double end as score_stddev, l_linenumber::bigint as sample_count, rk as ordinal, l_tax
  from ranked),
moved as (select * replace (least(10.0::double, greatest(0.0::double, score + (l_tax - 0.04::double) * 25.0::double)) as score) from scores)"""


def _findings(name: str, source: str) -> str:
    return f"""
{name}_base as (select case_id, score as baseline_score, score_stddev as baseline_score_stddev, sample_count as baseline_sample_count from {source} where variant_type = 'baseline'),
{name}_joined as (select s.*, b.* exclude (case_id), s.score - b.baseline_score as delta,
  case s.variant_type when 'gaming' then (s.score - b.baseline_score) - 0.0::double when 'degradation' then (b.baseline_score - s.score) - 1.0::double else abs(s.score - b.baseline_score) - 0.5::double end as contrast,
  case when b.baseline_sample_count > 1 and s.sample_count > 1 and b.baseline_score_stddev is not null and s.score_stddev is not null
    then sqrt(b.baseline_score_stddev * b.baseline_score_stddev / b.baseline_sample_count + s.score_stddev * s.score_stddev / s.sample_count) end as se
  from {source} s join {name}_base b using (case_id) where s.variant_type <> 'baseline'),
{name} as (select case_id, variant_id, variant_type, baseline_score, score as variant_score, delta,
  case when variant_type = 'degradation' then contrast < 0 else contrast > 0 end as violated,
  coalesce(se > 0 and abs(contrast) <= list_extract({_T}, greatest(1, least(30, least(baseline_sample_count, sample_count) - 1))::integer) * se, false) as uncertain,
  se as delta_standard_error, score_stddev as variant_score_stddev, sample_count as variant_sample_count, baseline_score_stddev, baseline_sample_count, ordinal from {name}_joined)"""


def _cases(name: str, found: str) -> str:
    return f"""
{name} as (select case_id, any_value(baseline_score) as baseline_score,
  avg(baseline_score - variant_score) filter (variant_type = 'degradation') - greatest(0.0::double, max(delta) filter (variant_type = 'gaming')) as validity_margin from {found} group by case_id)"""


def _summary(name: str, found: str, cases: str, critical: str = "worst_gaming_gain >= 2.0 or weakest_degradation_drop <= -1.0") -> str:
    return f"""
{name}_raw as (select count(*) as variant_count, count(*) filter (violated) as violation_count, count(*) filter (violated)::double / count(*) as violation_rate,
  count(delta_standard_error) as uncertainty_evaluable_count, count(*) filter (uncertain) as uncertain_count,
  avg(delta) filter (variant_type = 'gaming') as mean_gaming_gain, max(delta) filter (variant_type = 'gaming') as worst_gaming_gain,
  avg(baseline_score - variant_score) filter (variant_type = 'degradation') as mean_degradation_drop, min(baseline_score - variant_score) filter (variant_type = 'degradation') as weakest_degradation_drop,
  avg(abs(delta)) filter (variant_type = 'paraphrase') as mean_paraphrase_delta from {found}),
{name}_cases as (select count(*) as case_count, avg(validity_margin) as mean_validity_margin from {cases}),
{name} as (select *, uncertainty_evaluable_count < variant_count or uncertain_count > 0 as risk_is_provisional,
  case when {critical} then 'CRITICAL' when violation_rate >= 0.5 or mean_validity_margin <= 0 then 'HIGH' when violation_rate >= 0.25 then 'MEDIUM' else 'LOW' end as risk_level,
  case when case_count < 5 then 'anecdotal' when case_count < 30 then 'limited' else 'substantial' end as evidence_grade from {name}_raw cross join {name}_cases)"""


AUDIT = f"with {SCORES}, {_findings('f', 'scores')}, {_cases('c', 'f')}"
BOTH = f"{AUDIT}, {_findings('g', 'moved')}, {_cases('d', 'g')}"
SUMMARY = f"{AUDIT}, {_summary('s', 'f', 'c')}"
BOTH_SUMMARY = f"{BOTH}, {_summary('s', 'f', 'c')}, {_summary('t', 'g', 'd')}"
_SEVERITY = "case f.variant_type when 'gaming' then {0}.delta - 0.0::double when 'degradation' then {0}.delta + 1.0::double else abs({0}.delta) - 0.5::double end"
COMPARED = f"""
k as (select f.case_id, f.variant_id, f.variant_type, f.delta as reference_delta, g.delta as candidate_delta, {_SEVERITY.format("g")} - ({_SEVERITY.format("f")}) as severity_change,
  f.violated as reference_violated, g.violated as candidate_violated, f.uncertain as reference_uncertain, g.uncertain as candidate_uncertain,
  f.delta_standard_error is null or g.delta_standard_error is null or f.uncertain or g.uncertain as change_is_provisional
  from f join g on f.case_id = g.case_id and f.variant_id = g.variant_id),
compared as (select *, case when not reference_violated and candidate_violated then 'regression' when reference_violated and not candidate_violated then 'improvement'
  when severity_change > 1e-9 then 'worsened' when severity_change < -1e-9 then 'improved' else 'unchanged' end as status from k)"""
STATUSES = ("regression", "improvement", "worsened", "improved", "unchanged")
METRICS = ("mean_gaming_gain", "worst_gaming_gain", "mean_degradation_drop", "weakest_degradation_drop", "mean_paraphrase_delta", "mean_validity_margin")

SAMPLES = """
samples as (select user_id::varchar as case_id, event_type as variant_id, case event_type when 'view' then 'baseline' when 'click' then 'gaming' when 'error' then 'degradation' else 'paraphrase' end as variant_type,
  row_number() over (partition by user_id, event_type order by ts, event_id)::bigint as sample_index, least(10.0::double, value / 50.0::double) as score, 'event ' || event_id as reason,
  case when event_type <> 'signup' then len(props) end as prompt_tokens, len(props) as completion_tokens, (event_id % 13) / 10.0::double as latency_seconds, sha256(case when value > 100 then 'edited' else event_type end) as input_sha256
  from events)"""
STATE = f"""
planned as (select case_id, variant_id, variant_type, k.i::bigint as sample_index, sha256(variant_id) as input_sha256 from (select distinct case_id, variant_id, variant_type from samples) cross join (select unnest(range(1, {REPEATS + 1})) as i) k),
state as (select * from samples)"""

_SPACES = r"[\s\x0B\x1C-\x1F]"
BASELINES = """
baselines as (select doc_id::varchar as case_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') as text, doc_id as ordinal from documents)"""


def _class(characters: str, negated: bool = False) -> str:
    escaped = "".join("\\" + c if c in "[]\\^-" else c for c in characters)
    return f"[{'^' if negated else ''}{escaped}]"


def _sentences(text: str, language: Language = ENGLISH) -> str:
    ends = language.terminators
    return f"regexp_extract_all({text}, {_q('(?s)' + _class(ends, True) + '*' + _class(ends) + _class(language.closers) + '*|' + _class(ends, True) + '+$')})"


def _english(language: Language = ENGLISH) -> str:
    """Sentences with the guards around full stops: what stands at every character, then the ends, then what lies between them."""
    abbreviations = "(" + ", ".join(map(_q, sorted(language.abbreviations))) + ")"
    return f"""
letters as (select case_id, text, unnest(range(1, len(text) + 1))::bigint as i, unnest(string_split(text, '')) as c from baselines where text <> ''),
marked as (select *, max(case when not regexp_full_match(c, '[\\pL.]') then i else 0 end) over before as other, min(case when not regexp_full_match(c, '[\\s\\pZ\\x1C-\\x1F\\x85]') then i end) over after as next_at,
  min(case when not contains({_q(language.closers)}, c) then i end) over after as closed_at, lag(c) over place as prior_c, lead(c) over place as next_c
  from letters window before as (partition by case_id order by i rows between unbounded preceding and 1 preceding), after as (partition by case_id order by i rows between 1 following and unbounded following), place as (partition by case_id order by i)),
stops as (select *, lower(replace(substring(text, coalesce(other, 0) + 1, i - 1 - coalesce(other, 0)), '.', '')) as word, substring(text, next_at, 1) as next_letter from marked where contains({_q(language.terminators)}, c)),
ends as (select case_id, text, coalesce(closed_at - 1, len(text)) as e from stops where not (contains({_q(language.ambiguous)}, c) and (
  coalesce(regexp_full_match(prior_c, '\\p{{Nd}}') and regexp_full_match(next_c, '\\p{{Nd}}'), false) or len(word) = 1 or word in {abbreviations} or coalesce(regexp_full_match(next_letter, '\\p{{Ll}}'), false)))
  union select case_id, text, len(text) from baselines where text <> ''),
english as (select case_id, row_number() over w as number, substring(text, coalesce(lag(e) over w, 0) + 1, e - coalesce(lag(e) over w, 0)) as sentence from ends window w as (partition by case_id order by e))"""


SPLIT = f"""
x as (select *, {_sentences("text")} as sentences, '' as notes from baselines),
split as (select *, least(2, len(sentences)) as e, list_filter(sentences, lambda s, i: i <> least(2, len(sentences))) as kept from x)"""


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


def _pick(strategy: str, n: int, number: int = 0, key: str = "case_id") -> str:
    return f"(('0x' || substr(md5('{SEED}|{strategy}|{number}|' || {key}), 1, 8))::bigint % {n})::integer"


def _addition(strategy: str, produced: str, count: int, extra: str = "") -> str:
    return f"""with {BASELINES}, {SPLIT}{extra}, made as (select *, {produced} as produced from {"picked" if extra else "split"})
select case_id, 'gaming_{strategy}' as variant_id, 'gaming' as variant_type, produced as text,
  'generated={strategy} | added_characters=' || (len(produced) - len(text)) || '; added_sentences={count}' as notes, null::varchar as problem from made"""


def _degradation(strategy: str, produced: str, removed: str) -> str:
    shorter = "when len(produced) >= len(text) then 'remove_evidence did not shorten the baseline.'" if strategy == "remove_evidence" else ""
    return f"""with {BASELINES}, {SPLIT}, j as (select *, array_to_string(kept, '') as joined from split), k as (select *, {_strip("joined")} as bare from j), made as (select *, {produced} as produced from k)
select case_id, 'degradation_{strategy}' as variant_id, 'degradation' as variant_type, produced as text,
  'generated={strategy}' || coalesce(' | removed_characters=' || ({removed}) || '; removed_sentences=' || (e > 0)::integer || '; removed_share=' || printf('%.3f', ({removed})::double / nullif(len(text), 0)), '') as notes,
  case {shorter} when contains(produced, sentences[e]) then '{strategy} still contains an annotated sentence.' end as problem from made"""


def _connectives() -> str:
    """Nested replacements, each after the text's start or a boundary; DuckDB has no lookbehind, so the boundary is put back."""
    bounds = _class(BOUNDARIES)
    steps, text, counts = [], "t0", []
    prior = "front"
    for n, (source, target) in enumerate(ENGLISH.connectives):
        pattern = _q(f"(^|{bounds}){source}([^\\pL]|$)")
        steps.append(f"c{n} as (select *, regexp_replace(t{n}, {pattern}, {_q(chr(92) + '1' + target + chr(92) + '2')}, 'g') as t{n + 1}, len(regexp_extract_all(t{n}, {pattern})) as n{n} from {prior})")
        counts.append(f"n{n}")
        prior = f"c{n}"
    last = len(ENGLISH.connectives)
    return f"""with {BASELINES}, {SPLIT}, front as (select case_id, (case ordinal % 3 when 0 then 'However, ' when 1 then 'finally it was. In addition ' else '' end) || text as t0 from split), {", ".join(steps)}
select case_id, t{last} as text, 'generated=connective_substitution | replaced_connectives=' || ({" + ".join(counts)}) || ' | weak_probe=surface_only' as notes,
  case when ({" + ".join(counts)}) = 0 then 'connective_substitution found no connective to replace.' end as problem from {prior}"""


MERGED = f"""
gen as (select case_id, ordinal, 'gaming_rubric_flattery' as variant_id, text || ' ' || {_q(ENGLISH.flattery)} as text from split),
ex as (select case_id, case when starts_with(text, 'T') then 'by_hand' else variant_id end as variant_id, case when contains(text, '!') then text || ' edited' else text end as text from gen where not regexp_matches(text, '[0-9]')),
merged as (select case_id, variant_id, case when e.text is null then 'appended' when g.text is null then 'foreign' when g.text = e.text then 'preserved' else 'edited' end as merge_class, coalesce(e.text, g.text) as text
  from gen g full join ex e using (case_id, variant_id))"""

def _negations(text: str, language: Language) -> str:
    if language.word_boundaries:
        return f"len(list_filter(regexp_extract_all(lower({text}), '[A-Za-z'']+'), lambda w: list_contains({_list(language.negations)}, w)))"
    return f"len(regexp_extract_all({text}, '{'|'.join(language.negations)}'))"


def _numbers(text: str, language: Language) -> str:
    found = f"regexp_extract_all({text}, '[0-9]+(?:\\.[0-9]+)?')"
    units = "|".join(sorted(language.measures, key=len, reverse=True))
    return f"list_concat({found}, regexp_extract_all({text}, '[{language.numerals}]+(?:{units})'))" if language.numerals else found


def _drafts(language: Language, as_read: str = "coalesce(text, '')") -> str:
    return f"""
texts as (select doc_id, {as_read} as text from documents),
pairs as (select a.doc_id::varchar as case_id, a.text as baseline_text, coalesce(b.text, '') as draft_text, {_strip("a.text")} as b, {_strip("coalesce(b.text, '')")} as d from texts a left join texts b on b.doc_id = a.doc_id + 1),
noted as (select *, list_sort(list_distinct(list_filter({_numbers("b", language)}, lambda n: not contains(d, n)))) as gone, {_negations("b", language)} as before, {_negations("d", language)} as after from pairs),
drafts as (select case_id, baseline_text, draft_text,
  case when d = '' then 'empty' else concat_ws('; ', case when d = b then 'identical' when b <> '' and contains(d, b) then 'echoes_baseline' end, case when b <> '' and not (len(d)::double / len(b) between 0.4 and 2.5) then 'length_out_of_band' end) end as blocking_checks,
  case when d = '' then '' else concat_ws('; ', case when len(gone) > 0 then 'numbers missing from the draft: ' || array_to_string(gone, ', ') end, case when before <> after then 'negations changed from ' || before || ' to ' || after end) end as review_notes from noted),
reviewed as (select *, case when blocking_checks <> '' then 'blocked' else 'pending' end as status from drafts)"""


DRAFTS = _drafts(ENGLISH)
IN_CHINESE = f"translate({{0}}, {_q(CHINESE_FROM)}, {_q(CHINESE_TO)})"

TRAJECTORIES = """
turns as (select conv_id, turn, role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn, role, coalesce(text, '')) as i, count(*) over (partition by conv_id) as n from conversations),
steps as (select conv_id::varchar as case_id, i, n, role as tool, '{}' as args, text as result, '' as note from turns where n >= 3)"""


def _rendered(words: Labels) -> str:
    def line(label: str, value: str) -> str:
        return f"chr(10) || '  {label}{words.mark}' || {value}"

    step = f"'{words.step} ' || i || {line(words.tool, 'tool')} || {line(words.args, 'args')} || {line(words.result, 'result')} || chr(10)"
    return f"""select case_id, '{words.task}{words.mark}conversation' || chr(10) || chr(10) || string_agg({step}, chr(10) order by i) || chr(10) || '{words.answer}{words.mark}' || arg_max(result, i) as text from steps group by case_id"""


def _listed(source: str, strategy: str, family: str, notes: str, problem: str = "null::varchar") -> str:
    return f"""select case_id, '{family}_{strategy}' as variant_id, string_agg(new_i || '|' || tool || '|' || args || '|' || result || '|' || note, chr(10) order by new_i) as steps, {notes} as notes, {problem} as problem from {source} group by case_id"""


_FIRST = f"(('0x' || substr(md5('{SEED}|redundant_tool_calls|0|' || case_id), 1, 8))::bigint % n)::integer + 1"
_STEP1 = "max(case when i = 1 then {0} end)"
_BLANK = f"max(case when i = 1 and {_strip('old')} = '' then 1 else 0 end) = 1"

ORACLE_SQL: dict[str, str] = {
    "audit_findings": f"{AUDIT} select case_id, variant_id, variant_type, baseline_score, variant_score, delta, violated, uncertain, round(delta_standard_error, 9) as delta_standard_error, variant_score_stddev, variant_sample_count, baseline_score_stddev, baseline_sample_count from f",
    "audit_case_margins": f"{AUDIT} select case_id, baseline_score, round(validity_margin, 9) + 0.0::double as validity_margin from c",
    "audit_summary": f"""{SUMMARY} select case_count, variant_count, violation_count, round(violation_rate, 9) as violation_rate, uncertainty_evaluable_count, uncertain_count, round(mean_gaming_gain, 9) as mean_gaming_gain, worst_gaming_gain,
  round(mean_degradation_drop, 9) as mean_degradation_drop, weakest_degradation_drop, round(mean_paraphrase_delta, 9) as mean_paraphrase_delta, round(mean_validity_margin, 9) as mean_validity_margin, risk_is_provisional, risk_level, evidence_grade from s""",
    "audit_risk": f"""{SUMMARY}, {_summary("u", "f", "c", "worst_gaming_gain >= 10.0::double * 0.2 or weakest_degradation_drop <= -(10.0::double * 0.1)")}
select 'none' as scale, risk_level, risk_is_provisional from s union all select '0-10', risk_level, risk_is_provisional from u""",
    "audit_headroom": f"{AUDIT} select count(*) as case_count, count(*) filter (10.0::double - baseline_score < 1.0) as ceiling_limited_count, count(*) filter (baseline_score - 0.0::double < 1.0) as floor_limited_count from c",
    "audit_uncertainty": f"{AUDIT} select variant_type, count(*) as variants, count(delta_standard_error) as evaluable, count(*) filter (uncertain) as uncertain, round(avg(delta_standard_error), 9) as mean_standard_error from f group by variant_type",
    "audit_nested_cases": f"""{AUDIT}, v as (select case_id, count(*)::integer as n, string_agg(variant_id, ',' order by ordinal) as variant_ids, round(max(abs(delta)), 9) as largest_change from f group by case_id)
select case_id, baseline_score, round(validity_margin, 9) + 0.0::double as validity_margin, n, variant_ids, largest_change from c join v using (case_id)""",
    "evidence_grade": f"{SUMMARY} select case_count, evidence_grade from s",
    "strategy_mean_delta": f"{AUDIT} select variant_id, variant_type, count(*) as n, round(avg(delta), 9) as mean_delta, count(*) filter (violated) as violations from f group by variant_id, variant_type",
    "score_row_violations": f"""with {SCORES}, v as (select * replace (case when sample_count <> 5 then score_stddev end as score_stddev) from scores)
select 'range' as rule_id, count(*) as n from v where not (score between 1.0 and 9.0) having count(*) > 0 union all select 'stddev_missing', count(*) from v where sample_count > 1 and score_stddev is null having count(*) > 0""",
    "pairing_violations": f"""with {SCORES}, p as (select case_id, count(*) filter (variant_type = 'baseline') as baselines, bool_or(variant_type = 'gaming') as has_gaming, bool_or(variant_type = 'degradation') as has_degradation
  from scores where not (variant_id = 'v3' and sample_count >= 5) group by case_id) select * from p where baselines <> 1 or not has_gaming or not has_degradation""",
    "duplicate_keys": f"with {SCORES} select case_id, 'n' || sample_count as variant_id, count(*) as n from scores group by 1, 2 having count(*) > 1",
    "compare_findings": f"""{BOTH}, {COMPARED} select case_id, variant_id, variant_type, round(reference_delta, 9) + 0.0::double as reference_delta, round(candidate_delta, 9) + 0.0::double as candidate_delta, round(severity_change, 9) + 0.0::double as severity_change,
  reference_violated, candidate_violated, reference_uncertain, candidate_uncertain, change_is_provisional, status from compared""",
    "compare_status_counts": f"{BOTH}, {COMPARED} select status, count(compared.case_id) as n from (select unnest({_list(STATUSES)}) as status) left join compared using (status) group by status",
    "compare_metrics": f"{BOTH_SUMMARY} " + " union all ".join(f"select '{m}' as metric, round(s.{m}, 9) as reference, round(t.{m}, 9) as candidate, round(t.{m} - s.{m}, 9) as change from s cross join t" for m in METRICS),
    "compare_totals": f"""{BOTH_SUMMARY}, {COMPARED}, n as (select count(*) as variant_count, {", ".join(f"count(*) filter (status = '{x}') as {x}_count" for x in STATUSES)}, count(*) filter (change_is_provisional) as provisional_change_count from compared)
select n.*, s.risk_level as reference_risk_level, s.risk_is_provisional as reference_risk_is_provisional, round(s.violation_rate, 9) as reference_violation_rate, s.uncertain_count as reference_uncertain_count,
  t.risk_level as candidate_risk_level, t.risk_is_provisional as candidate_risk_is_provisional, round(t.violation_rate, 9) as candidate_violation_rate, t.uncertain_count as candidate_uncertain_count,
  (list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], t.risk_level) - list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], s.risk_level))::integer as risk_rank_change, round(t.violation_rate - s.violation_rate, 9) as violation_rate_change from n cross join s cross join t""",
    "compare_identity_diff": f"""{BOTH}, r as (select case_id, variant_id, true as a from f where variant_sample_count <> 7), q as (select case_id, variant_id, true as b from g where variant_id <> 'v7')
select case_id, variant_id, case when a is null then 'reference' else 'candidate' end as missing_in from r full join q using (case_id, variant_id) where a is null or b is null""",
    "compare_self_consistency": f"{SUMMARY} " + " union all ".join(f"select '{m}' as field, round({m}::double, 9) as declared, round({m}::double, 9) as actual, true as agrees from s" for m in ("variant_count", "violation_count", "uncertain_count", "violation_rate")),
    "report_order": f"{BOTH}, {COMPARED} select case_id, variant_id, status, list_position({_list(STATUSES)}, status)::integer as status_rank, round(abs(severity_change), 9) as size, row_number() over (order by list_position({_list(STATUSES)}, status), abs(severity_change) desc, case_id, variant_id) as position from compared",
    "repeat_aggregate": f"with {SAMPLES} select case_id, variant_id, variant_type, round(avg(score), 9) as score, round(stddev_samp(score), 9) as score_stddev, count(*) as sample_count, arg_min(reason, sample_index) as first_reason from samples group by 1, 2, 3",
    "token_totals": f"with {SAMPLES} select case when count(*) = count(prompt_tokens) then sum(prompt_tokens)::bigint end as prompt_tokens_total, case when count(*) = count(completion_tokens) then sum(completion_tokens)::bigint end as completion_tokens_total from samples",
    "latency_totals": f"""with {SAMPLES}, r as (select *, sample_index <= 2 as resumed from samples) select count(*) as sample_count, count(*) filter (resumed) as resumed_sample_count, count(*) filter (not resumed) as new_sample_count,
  round(sum(latency_seconds), 9) as total_sample_latency_seconds, round(sum(latency_seconds) filter (not resumed), 9) as new_sample_latency_seconds from r""",
    "resume_missing": f"with {SAMPLES}, {STATE} select case_id, variant_id, sample_index from planned anti join state using (case_id, variant_id, sample_index)",
    "resume_foreign": f"with {SAMPLES}, {STATE} select case_id, variant_id, sample_index from state anti join planned using (case_id, variant_id, sample_index)",
    "resume_mismatch": f"with {SAMPLES}, {STATE} select s.case_id, s.variant_id, s.sample_index from state s join planned p using (case_id, variant_id, sample_index) where s.variant_type <> p.variant_type or s.input_sha256 <> p.input_sha256",
    "planned_samples": f"with {BASELINES} select case_id, 'baseline' as variant_id, k.i::bigint as sample_index, sha256(text) as input_sha256 from baselines cross join (select unnest([1, 2, 3]) as i) k",
    "sentence_split": f"with {BASELINES}, z as (select case_id, {_sentences('text')} as s from baselines) select case_id, unnest(range(1, len(s) + 1))::bigint as number, unnest(s) as sentence from z",
    "sentence_split_english": f"with {BASELINES}, {_english()} select case_id, number, sentence from english",
    "gaming_verbose_padding": _addition(
        "verbose_padding", f"text || ' ' || list_extract({_list(ENGLISH.padding)}, p1 + 1) || ' ' || list_extract({_list(ENGLISH.padding)}, p2 + 1)", 2,
        f""", drawn as (select *, {_pick("verbose_padding", 6)} as p1, {_pick("verbose_padding", 5, 1)} as q2 from split), picked as (select *, case when q2 >= p1 then q2 + 1 else q2 end as p2 from drawn)""",
    ),
    "gaming_rubric_flattery": _addition("rubric_flattery", f"text || ' ' || {_q(ENGLISH.flattery)}", 1),
    "degradation_remove_evidence": _degradation("remove_evidence", "bare", "len(text) - len(bare)"),
    "degradation_unsupported_assertion": _degradation("unsupported_assertion", f"bare || ' ' || list_extract({_list(ENGLISH.assertions)}, {_pick('unsupported_assertion', 3)} + 1)", "len(text) - len(joined)"),
    "paraphrase_connective_substitution": _connectives(),
    "merge_classify": f"with {BASELINES}, {SPLIT}, {MERGED} select case_id, variant_id, merge_class, text from merged",
    "merge_origin": f"""with {BASELINES}, {SPLIT}, {MERGED} select {", ".join(f"count(*) filter (merge_class = '{k}') as {k}" for k in ("appended", "preserved", "edited", "foreign"))},
  case when count(*) filter (merge_class in ('edited', 'foreign')) > 0 then 'mixed' else 'machine-generated' end as set_origin from merged""",
    "review_checks": f"with {DRAFTS} select case_id, blocking_checks, review_notes, status from reviewed",
    "review_tally": f"with {DRAFTS} select s as status, count(reviewed.case_id) as n from (select unnest(['pending', 'blocked', 'approved', 'rejected']) as s) left join reviewed on status = s group by s",
    "ratified_rows": f"""with {DRAFTS}, {BASELINES}, hashed as (select r.case_id, r.draft_text, sha256({_json("r.baseline_text")}) as drafted, sha256({_json("k.text")}) as expected, k.ordinal from reviewed r join baselines k on k.case_id = r.case_id where r.status = 'pending')
select case_id, 'paraphrase_ratified' as variant_id, 'paraphrase' as variant_type, draft_text as text, 'generated=human_ratified_paraphrase' || case when ordinal % 2 = 0 then ' | reviewer_note=read' else '' end as notes,
  case when drafted <> expected then 'Case ''' || case_id || ''' was edited after its rewrite was drafted; draft it anew.' end as problem from hashed""",
    "traj_render": f"with {TRAJECTORIES} {_rendered(ENGLISH.labels)}",
    "traj_redundant_tool_calls": f"""with {TRAJECTORIES}, p as (select *, {_FIRST} as a from steps), q as (select *, i in (a, a % n + 1) as again from p),
o as (select *, row_number() over (partition by case_id order by i, d) as new_i from (select *, unnest(case when again then [1, 2] else [1] end) as d from q)),
collapsed as (select case_id, bool_or(tool = pt and result = pr) as twice from (select *, lag(tool) over (partition by case_id order by i) as pt, lag(result) over (partition by case_id order by i) as pr from steps) group by case_id),
listed as ({_listed("o", "redundant_tool_calls", "gaming", "'generated=redundant_tool_calls | added_steps=2 repeated_steps=[' || least(any_value(a), any_value(a) % any_value(n) + 1) || ', ' || greatest(any_value(a), any_value(a) % any_value(n) + 1) || ']'")})
select l.* replace (case when twice then 'redundant_tool_calls changed the sequence of the baseline.' end as problem) from listed l join collapsed using (case_id)""",
    "traj_padded_reasoning": f"""with {TRAJECTORIES}, o as (select * replace (list_extract({_list(ENGLISH.padding)}, ({_pick("padded_reasoning", 6)} + i - 1) % 6 + 1) as note), i as new_i from steps)
{_listed("o", "padded_reasoning", "gaming", "'generated=padded_reasoning | added_note_characters=' || sum(len(note))::bigint || ' padded_steps=[' || string_agg(i::varchar, ', ' order by i) || ']'")}""",
    "traj_remove_load_bearing_step": f"""with {TRAJECTORIES}, o as (select *, i - 1 as new_i from steps where i > 1) {_listed("o", "remove_load_bearing_step", "degradation", "'generated=remove_load_bearing_step | remaining_steps=' || count(*) || ' removed_steps=[1]'")}""",
    "traj_hollow_evidence": f"""with {TRAJECTORIES}, o as (select *, i as new_i, result as old from steps), h as (select * replace (case when i = 1 then '{ENGLISH.empty_result}' else result end as result) from o)
{_listed("h", "hollow_evidence", "degradation", "'generated=hollow_evidence | hollowed_steps=[1] removed_result_characters=' || " + _STEP1.format("len(old)"), f"case when {_BLANK} then 'hollow_evidence finds a load-bearing step that returns nothing already.' when contains('{ENGLISH.empty_result}', {_STEP1.format('old')}) then 'hollow_evidence left an original result in place.' end")}""",
    "traj_reorder_independent_steps": f"""with {TRAJECTORIES}, o as (select *, case i when 1 then 2 when 2 then 1 else i end as new_i from steps)
{_listed("o", "reorder_independent_steps", "paraphrase", "'generated=reorder_independent_steps | reordered_groups=[[1, 2]]'", "case when " + _STEP1.format("tool") + " = max(case when i = 2 then tool end) and " + _STEP1.format("result") + " = max(case when i = 2 then result end) then 'reorder_independent_steps moved nothing: the declared steps are the same.' end")}""",
    "row_fingerprint": f"""with {BASELINES} select case_id, sha256('{{"case_id":"' || case_id || '","notes":"","text":' || {_json("text")} || ',"variant_id":"baseline","variant_type":"baseline"}}') as fingerprint from baselines""",
}
_PLACES = ("gaming_verbose_padding", "gaming_rubric_flattery", "degradation_remove_evidence", "degradation_unsupported_assertion")
_TRAJECTORY_PLACES = ("traj_redundant_tool_calls", "traj_padded_reasoning", "traj_remove_load_bearing_step", "traj_hollow_evidence", "traj_reorder_independent_steps")
# as the query of connectives, without the words that it sets at the front
_SUBSTITUTED = _connectives().replace("(case ordinal % 3 when 0 then 'However, ' when 1 then 'finally it was. In addition ' else '' end) || text as t0", "text as t0")
ORACLE_SQL |= {
    "sentence_split_chinese": f"with {BASELINES}, z as (select case_id, {_sentences(IN_CHINESE.format('text'), CHINESE)} as s from baselines) select case_id, unnest(range(1, len(s) + 1))::bigint as number, unnest(s) as sentence from z",
    "review_checks_chinese": f"with {_drafts(CHINESE, IN_CHINESE.format("coalesce(text, '')"))} select case_id, blocking_checks, review_notes, status from reviewed",
    "traj_render_chinese": f"with {TRAJECTORIES} {_rendered(CHINESE.labels)}",
    "traj_parse": f"""with {TRAJECTORIES} select case_id::bigint as ordinal, case_id, string_agg(i || '|' || tool || '|{{"a": "x", "z": ' || i || '}}|' || result || '|', chr(10) order by i) as steps, 'the answer of ' || case_id as final_answer, null::varchar as problem from steps group by case_id""",
    "generate_all": f"""with {BASELINES} select ordinal * 6 as row_order, case_id, 'baseline' as variant_id, 'baseline' as variant_type, text, 'generated=baseline' as notes from baselines"""
    + "".join(f" union all select case_id::bigint * 6 + {k}, case_id, variant_id, variant_type, text, notes from ({ORACLE_SQL[name]})" for k, name in enumerate(_PLACES, 1))
    + f" union all select case_id::bigint * 6 + 5, case_id, 'paraphrase_connective_substitution', 'paraphrase', text, notes from ({_SUBSTITUTED})",
    "traj_generate": f"with {TRAJECTORIES} select distinct case_id::bigint * 6 as row_order, case_id, 'baseline' as variant_id, 'baseline' as variant_type, 'generated=trajectory_baseline' as notes, null::varchar as problem from steps"
    + "".join(f" union all select case_id::bigint * 6 + {k}, case_id, variant_id, split_part(variant_id, '_', 1), notes, problem from ({ORACLE_SQL[name]})" for k, name in enumerate(_TRAJECTORY_PLACES, 1)),
    "merge_order": f"""with {BASELINES}, {SPLIT}, {MERGED}, placed as (select case_id, variant_id, merge_class = 'foreign' as is_foreign from merged) select *, row_number() over (order by is_foreign, case_id::bigint) as position from placed""",
    "score_table": f"""with {SCORES} select 'lineitem' as system_name, case_id, variant_id, variant_type, printf('%.10g', score) as score, coalesce(printf('%.10g', score_stddev), '') as score_stddev, sample_count::varchar as sample_count, '' as notes from scores""",
    "review_table": f"with {DRAFTS} select case_id, sha256({_json('baseline_text')}) as baseline_sha256, baseline_text, draft_text, status, blocking_checks, review_notes, '' as reviewer_note from reviewed",
}
