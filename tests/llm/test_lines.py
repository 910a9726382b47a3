import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from probity.llm import lines, words


def brute(rows, least):
    counts, first = Counter(), {}
    for i, text in rows:
        for t in {t for line in (text or "").encode().split(b"\n") for t in lines.templates(line)}:
            counts[t] += 1
            if i is not None:
                first[t] = min(first.get(t, i), i)
    out = []
    for i, text in rows:
        kept = [x for x in (text or "").split("\n") if not any(counts[t] >= least and t in first and first[t] != i for t in lines.templates(x.encode()))]
        out.append((i, text if text is None else "\n".join(kept), 0 if text is None else text.count("\n") + 1))
    return out


def test_as_by_brute_force(docs):
    key = lambda r: tuple((x is None, x) for x in r)
    found = [(r["doc_id"], r["text"], r["n_lines"]) for r in lines.drop_recurring_lines(docs).collect()]
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()], lines.MIN_DOCS)
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert any(a != b for a, b in zip(sorted(found, key=key), sorted(((r["doc_id"], r["text"], 0) for r in docs.collect()), key=key)))


def test_variable_fields_share_a_template():
    a, b = (lines.templates(x.encode()) for x in ("Posted by user17 at 10:33 on 2024-01-02 with thanks to all of you here and there", "Posted by user99 at 23:01 on 2025-07-30 with thanks to all of you here and there"))
    assert a == b and len(a) == lines.BANDS
    c = lines.templates(b"Posted by user17 at 10:33 on 2024-01-02 with thanks to all of them there and elsewhere")
    assert set(a) & set(c) and set(a) != set(c)
    assert not set(a) & set(lines.templates(b"Posted by user17 at 10:33 on 2024-01-02 but no longer with any of that at hand"))


def test_short_lines_and_numbers_are_not_generalised():
    assert lines.templates(b"Of it.") == [] and lines.templates(b"") == []
    assert lines.templates(b"1 2 3") != lines.templates(b"4 5 6")


def test_every_recurring_line_stays_in_its_first_document(docs):
    before = {x for r in docs.collect() for x in (r["text"] or "").split("\n")}
    after = {x for r in lines.drop_recurring_lines(docs).collect() for x in (r["text"] or "").split("\n")}
    gone = before - after
    kept = {t for x in after for t in lines.templates(x.encode())}
    assert all(set(lines.templates(x.encode())) & kept for x in gone if x.strip())


def test_other_columns_and_empty_table(docs, no_docs):
    out = lines.drop_recurring_lines(docs)
    assert set(docs.columns) | {"n_lines", "n_dropped"} == set(out.columns)
    assert lines.drop_recurring_lines(no_docs).count() == 0


def _words(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_a_run_of_fifty_words_is_found_wherever_it_stands(spark):
    run, other = _words("run", 60), _words("other", 49)
    half = run.split()
    texts = [
        f"{_words('a', 20)} {run} end", f"begin {run}", f"{_words('c', 7)} {' '.join(half[:50])} and {_words('d', 40)}\nlast line",
        f"{other} {_words('e', 30)}", f"{_words('f', 3)} {other}", run.upper(),
    ]
    found = {r["doc_id"]: r for r in lines.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: r["text"] for i, r in found.items()} == {0: texts[0], 1: "begin ", 2: f"{_words('c', 7)} and {_words('d', 40)}\nlast line", 3: texts[3], 4: texts[4], 5: texts[5]}
    assert {i: r["n_dropped"] for i, r in found.items()} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_long_lines_without_spaces_are_deduplicated(spark):
    line = "本文の一行は空白なしで書かれている"
    rows = spark.createDataFrame([(i, f"{line}\nown {'abc'[i]}") for i in range(3)], "doc_id long, text string")
    assert [r["n_dropped"] for r in lines.drop_recurring_lines(rows).orderBy("doc_id").collect()] == [0, 1, 1]


def brute_all(rows, least=lines.MIN_DOCS):
    """Every line and every run of fifty words, counted in plain Python: {doc_id: text}; ids must be distinct."""
    parts = {i: (t or "").split("\n") for i, t in rows}
    holders = defaultdict(set)
    for i, own in parts.items():
        for line in own:
            for t in lines.templates(line.encode()):
                holders[t].add(i)
    gone = {(i, k) for i, own in parts.items() for k, line in enumerate(own) for t in lines.templates(line.encode()) if len(holders[t]) >= (lines.RUN_DOCS if t % 2 else least) and min(holders[t]) != i}
    runs = defaultdict(set)
    words = {(i, k): line.split() for i, own in parts.items() for k, line in enumerate(own) if (i, k) not in gone}
    for (i, _), w in words.items():
        for at in range(len(w) - lines.RUN + 1):
            runs[tuple(w[at : at + lines.RUN])].add(i)
    out = {}
    for i, t in rows:
        kept = []
        for k, line in enumerate(parts[i]):
            if (i, k) in gone:
                continue
            w = words[i, k]
            cut = {at + d for at in range(len(w) - lines.RUN + 1) if len(h := runs[tuple(w[at : at + lines.RUN])]) >= lines.RUN_DOCS and min(h) != i for d in range(lines.RUN)}
            left = [x for at, x in enumerate(w) if at not in cut]
            if not cut or left:
                kept.append(" ".join(left) if cut else line)
        out[i] = t if t is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("held", [lines.BROADCAST_HITS, 0])
def test_lines_and_runs_as_by_brute_force(spark, monkeypatch, held):
    """With hit lines broadcast to the texts, and with texts shuffled to them."""
    monkeypatch.setattr(lines, "BROADCAST_HITS", held)
    rng = random.Random(11)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    passages = [[rng.choice(words) for _ in range(rng.choice([49, 50, 51, 70, 130]))] for _ in range(8)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 4)):
            line = [rng.choice(words) for _ in range(rng.randint(0, 30))]
            for p in rng.sample(passages, rng.randint(0, 2)):
                begin = rng.choice([0, 0, rng.randrange(len(p))])
                line += p[begin:] + [rng.choice(words) for _ in range(rng.randint(0, 12))]
            own.append(" ".join(line))
        rows.append((i, "\n".join(own)))
    rows += [(100, rows[7][1]), (101, rows[7][1]), (102, None), (103, "")]
    found = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tidy = lambda t: t if t is None else "\n".join(" ".join(x.split()) for x in t.split("\n"))
    expected = brute_all(rows)
    assert {i: tidy(t) for i, t in found.items()} == {i: tidy(t) for i, t in expected.items()}
    assert sum(a != b for (_, a), b in zip(rows, expected.values())) > 20


def test_places_of_tokens_do_not_depend_on_the_slice():
    texts = ["a b\nhttp://x y:/ / z", "", "://", "//a @b 7\r\n c", "é 漢 字\x0b1"]
    raw = [t.encode() for t in texts]
    together = lines.Parsed(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    at = 0
    for number, line in ((k, n) for k, t in enumerate(raw) for n, line in enumerate(t.split(b"\n")) if line.split()):
        alone = raw[number].split(b"\n")[line]
        assert (together.text[at], together.number[at], together.n[at]) == (number, line, len(alone.split()))
        begin = together.first[at]
        assert together.variable[begin : begin + together.n[at]].tolist() == [any(c in t for c in b"0123456789@") or b"://" in t for t in alone.split()]
        assert together.exact()[at] == lines.Parsed(np.frombuffer(alone, np.uint8), np.array([0, len(alone)])).exact()[0]
        at += 1
    assert at == len(together.n)


def test_words_and_hashes_are_the_same_in_chunks_of_any_size(monkeypatch):
    texts = ["", "a\x0b\x0c\r\tb", "x" * 300 + " " + "y" * 70, "a", "é漢\x85\xa0\x1c\x00 1\n\n2", " "]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    expected = [w for t in raw for w in t.split()]
    found = []
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(words, "_CHUNK", size)
        begins, ends, hashes = words.words_in(data, offsets)
        assert [data[a:b].tobytes() for a, b in zip(begins, ends)] == expected
        found.append(hashes.tolist())
    assert found[0] == found[1] == found[2] and len(set(found[0])) == len(set(expected))


def test_texts_are_read_once_to_count_and_once_to_join(docs, monkeypatch):
    """Templates and half-runs come of the same passes; two more take runs and cut them."""
    passes, frame = [], type(docs)
    own = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *rest, **named: (passes.append(run.__name__), own(self, run, *rest, **named))[1])
    lines.drop_recurring_lines(docs)
    assert len(passes) == 4
