"""WARC round trip, packing, mixing, fingerprints and the pipeline."""

import gzip
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import op4_warc as op4
from ledgerline.llm import op6_packing as op6
from ledgerline.llm import op9_mixing as op9
from ledgerline.llm import op10_winnowing as op10


# -- WARC -------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    long = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 200
    pages = [(1, "http://a/x y", long), (5, "http://b", long), (3, None, long), (7, "u", "short"), (8, "u", "short"),
             (9, "u", None), (10, "u", ""), (None, "u", long), (11, "u", long + "x")]
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, record_type string")
    op4.write_archives(frame, str(tmp_path / "w"))
    records = op4.read_archives(spark, str(tmp_path / "w"))
    captures = op4.transactions(records)
    rows = captures.collect()
    assert len(rows) == len(pages)
    assert all(r.request and len(r.metadata) == 1 and r.response.record_id == r.capture_id for r in rows)
    for r in op4.captures_by_page(captures).collect():
        html = (dict((p[0], p[2]) for p in pages)[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 5) if r.page_id in (1, 3) else ("response", None))
    assert {bytes(r.response.payload) for r in rows if r.page_id == 5} == {long.encode()}


def test_warc_page_under_two_payloads(spark, tmp_path):
    one, two = "a" * 2000, "b" * 1500
    frame = spark.createDataFrame([(1, "u", one), (1, "u", two), (5, "v", one)], "page_id long, url string, html string")
    op4.write_archives(frame, str(tmp_path / "w"))
    got = op4.captures_by_page(op4.transactions(op4.read_archives(spark, str(tmp_path / "w")))).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == [
        (1, 1500, "response", 0), (1, 2000, "revisit", 5), (5, 2000, "response", 0)]


def test_warc_links_in_either_direction(spark, tmp_path):
    def record(kind, name, more, body=b""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n{more}Content-Length: {len(body)}\r\n\r\n"
        return gzip.compress(head.encode() + body + b"\r\n\r\n")  # a member for each record

    data = (record("response", "r1", "WARC-Concurrent-To: q1\r\n", b"one") + record("request", "q1", "")
            + record("metadata", "m1", "WARC-Concurrent-To: q1\r\n") + record("metadata", "m2", "WARC-Concurrent-To: r1\r\n")
            + record("response", "r2", "", b"two") + record("warcinfo", "i", ""))
    (tmp_path / "part-0.gz").write_bytes(data)
    got = {r.capture_id: r for r in op4.transactions(op4.read_archives(spark, str(tmp_path))).collect()}
    assert got["r1"].request.record_id == "q1" and {m.record_id for m in got["r1"].metadata} == {"m1", "m2"}
    assert got["r2"].request is None and got["r2"].metadata == []


def test_warc_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    op4.write_archives(empty, str(tmp_path / "w"))
    assert op4.captures_by_page(op4.transactions(op4.read_archives(spark, str(tmp_path / "w")))).count() == 0


# -- packing ----------------------------------------------------------------
def _ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing_covers_every_id_once(docs):
    got = op6.pack(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text)
    for key, pieces in by_doc.items():
        if len(texts[key]) > 1:
            continue  # rows that repeat an id are packed one by one
        ids = np.array(_ids(texts[key][0]), "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert set(by_doc) == set(texts)
    short = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        short += at < op6.WINDOW
    assert short <= docs.rdd.getNumPartitions()


def test_long_texts_take_the_other_tokenizer():
    encoder = op6.Encoder()
    for text in ("word " * 30_000, " " * 150_000, "é" * 120_000):
        assert encoder.ids(text).tolist() == _ids(text)[:-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=16, max_size=16), st.integers(1, 15))
def test_level_minimises_the_sum_of_squares(counts, size):
    packer = op6.Packer(16, 0, None)
    packer.count[1:16] = counts[1:]
    total = {}
    for level in range(0, 17 - size):
        if level and not packer.count[level]:
            continue
        after = packer.count.copy()
        after[level] -= bool(level)
        if level + size < 16:
            after[level + size] += 1
        total[level] = int((after[1:16] ** 2).sum())
    best = packer.level_for(size)
    assert total[best] == min(total.values())
    assert best == max(k for k, v in total.items() if v == total[best])


def test_packing_empty(nothing):
    assert op6.pack(nothing).count() == 0


# -- mixing -----------------------------------------------------------------
def _copies(key, mean):
    parts = max(1, math.ceil(mean / op9.BLOCK))
    n = 0
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"{op9.SEED}:{key}:{j}".encode()).hexdigest()[:13], 16) / 2 ** 52
        p = below = math.exp(-mean / parts)
        k = 0
        while below <= u and k < op9.TAIL:
            k += 1
            p *= mean / parts / k
            below += p
            n += 1
    return n


def test_mixing(spark):
    rows = [(i, f"t{i}", "a" if i % 10 else "b", i) for i in range(600)] + [(9000 + i, "x", None, 0) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no long")
    got = op9.replicate(docs, {"a": 1.0, "b": 2.0})
    assert got.columns == ["doc_id", "text", "source", "copy_no"]
    counts = Counter(r.doc_id for r in got.collect())
    rate = {"a": round(1 / 3 * 605 / 540, 6), "b": round(2 / 3 * 605 / 60, 6), None: 0.0}
    assert counts == Counter({k: _copies(k, rate[s]) for k, _, s, _ in rows if _copies(k, rate[s])})
    assert abs(sum(counts.values()) - 605) < 100


def test_mixing_large_means(spark):
    rates = spark.createDataFrame([("s", 50.0), ("z", 0.0)], "mix_source string, rate double")
    got = {r.mix_source: r for r in op9.with_distribution(rates).collect()}
    assert got["s"].parts == 4 and abs(got["s"].below[12] - sum(math.exp(-12.5) * 12.5 ** k / math.factorial(k) for k in range(13))) < 1e-12
    assert got["z"].below[0] == 1.0
    many = spark.createDataFrame([(i, "t", "s" if i else "rare") for i in range(200)], "doc_id long, text string, source string")
    n = op9.replicate(many, {"rare": 1.0}).count()
    assert n == _copies(0, 200.0) and 120 < n < 280


def test_mixing_edges(spark, docs, nothing):
    got = op9.mix_sources(spark, docs, "")
    assert got.columns == docs.columns and 0 < got.count() < 3 * docs.count()
    assert op9.replicate(nothing).count() == 0


def test_packing_takes_added_tokens_as_tokenizers_does():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = op6.Encoder()
    for text in ("<|endoftext|>", "one<|endoftext|> two", "<|endoftext", "x " * 60_000 + "<|endoftext|>y"):
        assert encoder.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert 50256 in encoder.ids("one<|endoftext|> two")


# -- fingerprints -----------------------------------------------------------
def _naive(text, k, w):
    points = np.array([ord(c) for c in text], np.uint64)
    if not len(points):
        return []
    grams = op10.window_hashes(op10.mix(points), min(k, len(points))) >> np.uint64(32)
    w = min(w, len(grams))
    out = []
    for i in range(len(grams) - w + 1):
        best = min(range(i, i + w), key=lambda j: (grams[j], -j))
        if not out or out[-1] != best:
            out.append(best)
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé😀", max_size=80), st.integers(1, 6), st.integers(1, 9))
def test_winnowing_chooses_the_rightmost_least(text, k, w):
    at, hashes = op10.winnow(text, k, w)
    assert at.tolist() == _naive(text, k, w) and len(at) == len(hashes)


def test_shared_passages_are_found():
    rng = np.random.default_rng(0)
    draw = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    for _ in range(30):
        passage = draw(op10.K + op10.W - 1)
        a = op10.winnow(draw(70) + passage + draw(33))[1]
        b = op10.winnow(draw(5) + passage + draw(90))[1]
        assert len(np.intersect1d(a, b))


def test_short_texts_are_nearer_to_their_edit_than_to_the_next(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(chr(97 + x) for x in rng.integers(0, 26, n)) for n in range(50, 201)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = op10.edited_fingerprints(docs).collect()
    assert len(got) == len(texts) and all(r.near_edited > r.near_next for r in got)


def test_fingerprints_and_neighbours(spark, docs, nothing):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
                  for r in op10.edited_fingerprints(docs).collect())
    want = Counter()
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        mark = [op10.winnow(t)[1] for t in (text, edited, after)]
        want[key, len(text), hashlib.sha256(edited.encode()).hexdigest(), op10.encode(mark[0]),
             round(op10.likeness(mark[0], mark[1]), 9), round(op10.likeness(mark[0], mark[2]), 9)] += 1
    assert got == want
    assert op10.edited_fingerprints(nothing).count() == 0
    assert op10.edited_fingerprints(docs.filter("doc_id = 0")).first().near_next == 1.0
    assert op10.fingerprints(docs).count() == len(rows)


# -- pipeline ---------------------------------------------------------------
def test_pipeline(spark, docs, table):
    import corpus_pipeline as p
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]
    kept = docs
    for name, step in p.STAGES[:-1]:
        before = kept
        kept = p.stage(step(spark, kept, table), f"test-{name}")
        assert kept.columns == docs.columns and kept.count() > 0
        if name != "mixing":
            assert kept.count() <= before.count()
    pieces = p.STAGES[-1][1](spark, kept, table)
    tokens = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert tokens.agg(F.max("n")).first()[0] <= op6.WINDOW
    assert p.run(spark, table).select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
