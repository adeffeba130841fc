"""Odd input of the operators: many languages, old files, broken headers,
weights without a match, columns with the operators' own names, line templates
against a plain version of the whole rule."""

import os
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import op1_language_id as op1
from ledgerline.llm import op2_stream_dedup as op2
from ledgerline.llm import op3_line_templates as op3
from ledgerline.llm import op4_warc as op4
from ledgerline.llm import op9_mixing as op9


# -- language ID ----------------------------------------------------------------
def test_all_of_many_languages_are_learnt(spark):
    rnd = random.Random(1)
    words = {f"l{i:03d}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)] for i in range(300)}
    rows = [(n * 300 + i, " ".join(rnd.choices(w, k=30)), lang) for i, (lang, w) in enumerate(words.items()) for n in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op1.learn(docs)
    assert set(model["names"]) == set(words)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(op1, "LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some words", f"l{i % 5}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3"):
        op1.learn(docs)


def test_repeated_rows_do_not_fill_the_sample(spark):
    docs = spark.createDataFrame([(1, "the same words again", "en")] * 5000 + [(3, "andere worte hier", "de")],
                                 "doc_id long, text string, lang string")
    assert set(op1.learn(docs)["names"]) <= {"en", "de"}


# -- exact dedup ----------------------------------------------------------------
def test_files_older_than_a_week_are_taken_in_a_later_call(spark, tmp_path):
    path, work = str(tmp_path / "documents.parquet"), str(tmp_path / "work")
    table = lambda ids: spark.createDataFrame([(i, f"text {i % 3}") for i in ids], "doc_id long, text string").coalesce(1)
    table(range(4)).write.parquet(path)
    op2.dedup_stream(spark, path, work).count()
    before = set(os.listdir(path))
    table(range(4, 9)).write.mode("append").parquet(path)
    old = time.time() - 60 * 86400
    for f in set(os.listdir(path)) - before:
        if f.endswith(".parquet"):
            os.utime(os.path.join(path, f), (old, old))
    got = op2.dedup_stream(spark, path, work).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(i, i % 3, 3) for i in range(9)]


# -- WARC -------------------------------------------------------------------------
def test_odd_headers_of_archives(spark, tmp_path):
    def record(page, length, body=b"GET"):
        return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{page}>\r\nX-Page-ID: {page}\r\n"
                f"Content-Length: {length}\r\n\r\n").encode() + body + b"\r\n\r\n"
    data = record("x7", 3) + record("9" * 30, 3) + record("-5", 3) + record("6", "many", b"")
    (tmp_path / "part-0").write_bytes(data)
    got = op4.read_archives(spark, str(tmp_path)).collect()
    assert [(r.record_id, r.page_id, r.payload_bytes) for r in got] == [
        ("<urn:x7>", None, 3), (f"<urn:{'9' * 30}>", None, 3), ("<urn:-5>", -5, 3), ("<urn:6>", 6, 0)]


# -- mixing -----------------------------------------------------------------------
@pytest.mark.parametrize("weights", [{"none": 1.0}, {"a": 0.0, "b": 0.0}, {}])
def test_weights_without_a_match_or_of_zero_give_no_copy(spark, weights):
    docs = spark.createDataFrame([(1, "x", "a"), (2, "y", "b"), (3, "z", None)], "doc_id long, text string, source string")
    assert op9.replicate(docs, weights or {"c": 0.0}).collect() == []


def test_columns_with_the_operators_own_names_pass_through(spark):
    own = ["mix_source", "mix_parts", "mix_below", "mix_copies", "MIX_PLACE", "template_doc", "template_gone", "template_me", "template_text"]
    docs = spark.createDataFrame([(i, f"served in {i} ms for all of you", "s", *[f"{c}{i}" for c in own]) for i in range(9)],
                                 "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in own))
    mixed = op9.replicate(docs, {"s": 1.0})
    assert mixed.columns == [*docs.columns, "copy_no"]
    assert all(r.MIX_PLACE == f"MIX_PLACE{r.doc_id}" and r.mix_source == f"mix_source{r.doc_id}" for r in mixed.collect())
    lines = op3.drop_lines(docs)
    assert lines.columns == [*docs.columns, "lines_gone"]
    assert sorted((r.doc_id, r.lines_gone, r.template_gone) for r in lines.collect()) == [
        (i, int(i > 0), f"template_gone{i}") for i in range(9)]


# -- line templates -----------------------------------------------------------------
def _plain_templates(rows):
    """The whole rule, line by line: numbers of the lines that go, by row."""
    any_, docs = op3.ANY, {}
    for i, t in rows:
        if t is not None:
            docs.setdefault((i, t), None)
    texts = sum(t is not None for _, t in rows)
    lines = []
    for doc in docs:
        for no, line in enumerate(doc[1].split("\n")):
            plain = [w for w in line.replace("\t", " ").split(" ") if w]
            if not plain:
                continue
            words = [any_ if any(c in "0123456789" for c in w) else w for w in plain]
            short = len(plain) if len(plain) < op3.MIN_WORDS else 0
            if short and set(words) == {any_}:
                words = plain
            leaf = (len(words), tuple(words if short else words[:op3.DEPTH]))
            lines.append((doc, no, leaf, short, tuple(words)))
    held = defaultdict(set)
    for doc, _, leaf, short, _ in lines:
        held[leaf, short].add(doc)
    enough = {leaf for (leaf, short), d in held.items()
              if len(d) >= (max(op3.SHORT_DOCS, texts * op3.SHORT_SHARE ** short) if short else op3.MIN_DOCS)}
    lines = [x for x in lines if x[2] in enough]
    by_line = defaultdict(set)
    for doc, _, leaf, _, words in lines:
        by_line[leaf, words].add(doc)
    votes = defaultdict(Counter)
    for (leaf, words), d in by_line.items():
        for place, w in enumerate(words[op3.DEPTH:]):
            votes[leaf, place][w] += len(d)
    template = {}
    for leaf in {leaf for leaf, _ in votes}:
        template[leaf] = []
        for place in range(leaf[0] - op3.DEPTH):
            w, n = min(votes[leaf, place].items(), key=lambda x: (-x[1], x[0]))
            template[leaf].append(w if 2 * n > sum(votes[leaf, place].values()) else None)
    groups = defaultdict(list)
    for doc, no, leaf, _, words in lines:
        t, key = template.get(leaf), (leaf, words, None)
        if t:
            known = sum(w is not None and w != any_ for w in t)
            places = [(w, x) for w, x in zip(words[op3.DEPTH:], t) if not (w == any_ and x == any_)]
            agree = sum(w == x and x != any_ for w, x in places)
            if 2 * known > len(t) and agree >= op3.SIMILAR * len(places):
                key = (leaf, None, known + sum(w != any_ for w in words[:op3.DEPTH]))
        groups[key].append((doc[0] is None, doc[0], no, doc))
    gone = defaultdict(set)
    for (_, _, fixed), found in groups.items():
        need = op3.MIN_DOCS if fixed is None else max(op3.MIN_DOCS, texts * op3.SHORT_SHARE ** fixed)
        if len({x[3] for x in found}) >= need:
            for x in sorted(found, key=lambda x: x[:3])[1:]:
                gone[x[3]].add(x[2])
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_line_templates_equal_the_plain_rule(spark, seed):
    rnd = random.Random(seed)
    words = ["the", "page", "was", "loaded", "by", "user", "of", "our", "site"]

    def line():
        kind = rnd.random()
        if kind < 0.3:
            return f"served from host {rnd.randint(1, 9)} in {rnd.randint(1, 99)} ms {rnd.choice(['today', 'now', 'then'])}"
        if kind < 0.5:
            return " ".join(["the page was", *rnd.choices(words, k=rnd.randint(1, 4)), rnd.choice(["ok", "late"])])
        if kind < 0.7:
            return rnd.choice(["Menu", "All rights reserved.", "Page 7", f"Page {rnd.randint(1, 9)}", str(rnd.randint(1, 3)), "", "\t"])
        return " ".join(rnd.choices(words, k=rnd.randint(1, 6)))
    rows = [(i, "\n".join(line() for _ in range(rnd.randint(0, 7)))) for i in range(250)]
    rows += [(900, None), (901, "")]
    want = _plain_templates(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.lines_gone) for r in op3.drop_lines(docs).collect()}
    for i, t in rows:
        away = want.get((i, t), set())
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in away)
        assert got[i] == (left, len(away)), (i, t)
    assert sum(n for _, n in got.values()) > 100


def test_a_leaf_with_very_many_lines_is_split(spark):
    """The template side is a scan, so that the join may split a hot leaf."""
    docs = spark.createDataFrame([(i, f"the page was seen by {chr(97 + i % 26)}{i % 7} people today") for i in range(60)],
                                 "doc_id long, text string")
    assert op3.dropped_lines(docs).agg(F.sum(F.size("gone"))).first()[0] == 59


def test_revisits_of_other_archives_go_by_record_id(spark, tmp_path):
    def record(kind, name, page, body, more=""):
        head = f"HTTP/1.1 200 OK\r\n\r\n{body}"
        return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{name}>\r\nX-Page-ID: {page}\r\n{more}"
                f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(head)}\r\n\r\n{head}\r\n\r\n")
    (tmp_path / "part-0").write_text(record("revisit", "b", 2, "", "WARC-Refers-To: <urn:a>\r\n") +
                                     record("revisit", "c", 3, "", "WARC-Refers-To: <urn:nowhere>\r\n"), newline="")
    (tmp_path / "part-1").write_text(record("response", "a", 7, "x" * 20), newline="")
    got = op4.captures_by_page(op4.transactions(op4.read_archives(spark, str(tmp_path)))).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got if r.page_id != 3) == [
        (2, 20, "revisit", 7), (7, 20, "response", None)]
    assert [(r.refers_to, r.payload_bytes) for r in got if r.page_id == 3] == [(None, 0)]


def test_repeated_rows_that_others_revisit(spark, tmp_path):
    body = "y" * 1200
    pages = spark.createDataFrame([(9, "u", body)] * 30 + [(i, "u", body) for i in range(5)], "page_id long, url string, html string")
    op4.write_archives(pages, str(tmp_path / "w"))
    captures = op4.transactions(op4.read_archives(spark, str(tmp_path / "w"))).cache()
    assert captures.count() == 35 and captures.filter(F.size("metadata") != 1).count() == 0
    got = op4.captures_by_page(captures).collect()
    assert sorted((r.page_id, r.refers_to or 0, r.payload_bytes) for r in got) == [(i, 9, 1200) for i in range(5)] + [(9, 0, 1200)] * 30
