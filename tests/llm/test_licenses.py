import re

import pytest
from hypothesis import HealthCheck, find, given, settings
from hypothesis import strategies as st

from probity.llm import licenses

ODD = ["", None, "mit", "MIT License", "the MIT LICENSE mit license", "GNU general\npublic-license v3", "cc-by cc by cc  by", "apache licenses", "éapache license", "Apache License"]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def test_base_as_by_brute_force(prose):
    for text in [*ODD, *prose, " ".join(x or "" for x in ODD)]:
        s = licenses.scan(text)
        assert (s.n_words, s.n_base, s.first_word, s.last_word, s.base_labels) == brute(text)
        assert set(filter(None, s.base_labels.split(","))) <= set(s.labels.split(",")) and 0 <= s.score <= 1


def test_there_are_hundreds_of_rules_in_order_of_priority():
    rules = licenses.rules()[0]
    assert len(rules) >= 200 and [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_a_keyword_is_part_of_whatever_its_rule_finds(data):
    """The prefilter must never hide a match."""
    rules = licenses.rules()[0]
    rule = data.draw(st.sampled_from(rules))
    text = data.draw(st.from_regex(rule.pattern.pattern.replace("(?<!\\S)", "").replace("(?!\\S)", ""), fullmatch=True, alphabet=st.characters(max_codepoint=0xFF)))
    assert rule.keyword in text


def test_every_name_has_its_keyword():
    for rule in licenses.rules()[0]:
        if rule.priority != licenses.NAME_PRIORITY:
            continue
        pattern = rule.pattern.pattern.replace("(?<!\\S)", "").replace("(?!\\S)", "")
        found = find(st.from_regex(pattern, fullmatch=True, alphabet=st.characters(max_codepoint=0xFF)), lambda x: True, settings=settings(max_examples=2, database=None, suppress_health_check=list(HealthCheck)))
        assert rule.keyword in found


@pytest.mark.parametrize("text,labels", [
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Released under the MIT License.", "mit"),
    ("All rights reserved.", "all-rights-reserved"),
    ("a text with no license at all", ""),
    ("Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("GNU Lesser General Public License v2.1", "lgpl-2.1"),
])
def test_labels(text, labels):
    assert licenses.scan(text).labels == labels


def test_contained_detections_are_suppressed():
    found = licenses.detect("licensed under the apache license version 2 0")
    assert [label for *_, label, _ in found] == ["apache-2.0"]
    for a in found:
        assert not any(b is not a and b[0] <= a[0] and b[1] >= a[1] and b[3] >= a[3] for b in found)


def test_table(spark, docs, no_docs):
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == docs.count() and licenses.scan_licenses(no_docs).count() == 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all((r["n_words"], r["n_base"]) == brute(texts[r["doc_id"]])[:2] for r in rows)
