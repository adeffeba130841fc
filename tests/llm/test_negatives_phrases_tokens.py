"""Hard negatives, phrases and Arrow token files against brute force."""

import math
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import op11_cover_tree as op11
from ledgerline.llm import op12_itemset_counting as op12
from ledgerline.llm import op13_arrow_tokens as op13


# -- hard negatives -----------------------------------------------------------
def _brute(rows, positives=5, negatives=10):
    size = max((len(x) for _, _, x in rows), default=0)
    rows = [(i, label, [*x, *[0] * (size - len(x))]) for i, label, x in rows]
    out = set()
    for a, la, xa in rows:
        if a % 100:
            continue
        score = sorted((-sum(p * q for p, q in zip(xa, x)), i, label) for i, label, x in rows if i != a)
        for sp, p, _ in [s for s in score if s[2] == la][:positives]:
            inside = [(-s, i) for s, i, label in score if label != la and -30 * sp <= -100 * s <= -90 * sp]
            out |= {(a, p, r, i, -sp, s) for r, (s, i) in enumerate(inside[:negatives], 1)}
    return out


def _mined(spark, rows):
    df = spark.createDataFrame([(i, str(label), list(x)) for i, label, x in rows], "vec_id long, label string, x array<long>")
    got = op11.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()
    return {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got}


def _vectors(n, seed, clusters):
    rnd = np.random.Generator(np.random.PCG64(seed))
    centres = rnd.integers(-60, 60, (clusters, 6))
    label = rnd.integers(0, 5, n)
    label[: n // 3] = 0  # a label with a third of all rows
    x = centres[rnd.integers(0, clusters, n)] + rnd.integers(-4, 5, (n, 6))
    x[n // 2: n // 2 + 40] = x[n // 2]  # ties
    return [(int(i), int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))]


def test_negatives_of_clustered_vectors_over_many_units_and_pivots(spark, monkeypatch):
    for name, v in (("UNIT_ROWS", 64), ("UNITS_PER_PIVOT", 2), ("BLOCK_ROWS", 3), ("BUCKET", 4)):
        monkeypatch.setattr(op11, name, v)
    rows = _vectors(900, 3, 12)
    assert _mined(spark, rows) == _brute(rows)


def test_negatives_with_odd_rows(spark):
    rows = [(0, 0, [5, 5]), (100, 0, [0, 0]), (200, 1, []), (1, 0, [4, 4]), (2, 1, [3, 3, 9]), (3, 1, [3, 3]),
            (4, 1, [-3, -3]), (5, 2, [2, 2]), (6, 0, [-1, 0])]
    assert _mined(spark, rows + rows[3:5]) == _brute(rows)  # repeated rows count once
    large = [(0, 0, [1 << 30, 3]), (1, 0, [1 << 30, 5]), (2, 1, [1 << 29, 7]), (3, 1, [(1 << 29) + 1, -9])]
    assert _mined(spark, large) == _brute(large)  # beyond 2^53
    assert _mined(spark, [(0, 0, [1])]) == set()


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, 1, [0.5, -0.25]), (None, 1, [0.5]), (2, None, [0.5]), (3, 1, None), (4, 1, [0.5, None]), (5, 1, [nan]), (6, 1, [inf])]
    df = spark.createDataFrame(data, "vec_id long, label int, e array<float>")
    got = op11.prepared(df, "vec_id", F.col("label"), F.transform("e", lambda c: c.cast("double") * 256)).collect()
    assert [(r.vec_id, r.x) for r in got] == [(1, [128, -64])]
    nothing = op11.prepared(df.filter("vec_id > 9"), "vec_id", F.col("label"), F.col("e"))
    assert op11.hard_negatives(nothing, F.col("vec_id") % 100 == 0).count() == 0


def test_tree_covers_and_skips():
    rnd = np.random.Generator(np.random.PCG64(1))
    x = (rnd.integers(-500, 500, (20, 4))[rnd.integers(0, 20, 600)] + rnd.integers(-3, 4, (600, 4))).astype(np.int64)
    m2 = float((x * x).sum(1).max())
    tree = op11.CoverTree(x, m2)
    n = tree.nodes
    leaf = n["first"] == n["last"]
    assert sorted(n["point"][leaf]) == list(range(600))
    d = op11._angles(op11.squared_distances(x.astype(float), x.astype(float), m2), m2)

    def below(i):
        return [n["point"][i]] if leaf[i] else [p for c in range(n["first"][i], n["last"][i]) for p in below(c)]
    for i in np.flatnonzero(~leaf)[:40]:
        assert d[n["point"][i], below(i)].max() <= n["angle"][i] + 1e-9
    made = 0
    for q in x[:50].astype(float):
        f = op11.Found(np.array([-(1 << 62)]), np.array([1 << 62]), 3)
        f.ids = np.arange(600)
        made += tree.search(q, f, np.ones(600, bool))
        want = sorted(((int(s), -i) for i, s in enumerate(x @ q)), reverse=True)[:3]
        assert list(zip(f.best[0][0], -f.best[0][1])) == want
    assert made < 50 * 600 / 3


# -- phrases ----------------------------------------------------------------------
def _phrase_counts(docs):
    counts, totals = Counter(), Counter()
    for d in docs:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d.text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[d.lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[d.lang or "und", tuple(words[i:i + k])] += 1
    return counts, totals


def _phrases(docs, least, top):
    counts, totals = _phrase_counts(docs)
    cand = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    above = Counter()
    for (lang, ws), a in cand.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                above[lang, ws[i:i + k]] = max(above[lang, ws[i:i + k]], a)
    rows = []
    for (lang, ws), a in cand.items():
        if 100 * above[lang, ws] >= 80 * a:
            continue
        cuts = [(2000000 * a // (counts[lang, ws[:k]] + counts[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        rows.append((lang, -score, -a, " ".join(ws).encode(), counts[lang, ws[:k]], counts[lang, ws[k:]]))
    out, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(rows):
        seen[lang] += 1
        if seen[lang] <= top:
            out.append((lang, seen[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return out


@pytest.mark.parametrize("shards, places", [(3, None), (2, 1 << 16)])
def test_phrases(docs, monkeypatch, shards, places):
    monkeypatch.setattr(op12, "GROUP_WORDS", 20000)
    monkeypatch.setattr(op12, "SLICE", 3000)
    if places:  # nearly all places are shared: exact all the same
        monkeypatch.setattr(op12, "slots", lambda rows, p, f=op12.slots: f(rows, p) % op12._U(64))
        monkeypatch.setattr(op12, "slot_column", lambda p, f=op12.slot_column: f(p) % 64)
    docs = docs.filter("doc_id IS NULL OR doc_id % 2 = 0")
    got = op12.phrases(docs, least=12, top=200, shards=shards, places=places)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == sorted(_phrases(docs.collect(), 12, 200))


def test_words_with_one_hash_are_counted_anew(spark, monkeypatch):
    docs = spark.createDataFrame([("en", "to be or not to be"), (None, "to be")] * 20, "lang string, text string")
    real, tried = op12.Counter.run, []

    def run(self):
        tried.append(self.seed)
        if len(tried) == 1:
            raise op12.HashClash
        return real(self)
    monkeypatch.setattr(op12.Counter, "run", run)
    found, totals = op12.frequent(docs, least=30)
    assert len(set(tried)) == 2
    assert {(r.lang, r.total) for r in totals.collect()} == {("en", 120), ("und", 40)}
    assert {(r.lang, r.word, r.n) for r in found.filter("w2 = 0").collect()} == {("en", "to", 40), ("en", "be", 40)}
    assert [r.n for r in found.filter("w2 <> 0").collect()] == [40]


def test_tables_of_steps_stay_small_and_apart_from_the_function(spark, monkeypatch):
    """At 6 GB a worker held three tables of 128 MB twice: in the function's bytes, and as arrays."""
    sizes = lambda n: sum(op12.Steps(p, op12.LONGEST * op12.SHARDS).cells.nbytes for p in op12.table_places(n))
    assert sizes(6 * 10**9) <= 56 << 20
    assert sizes(10**13) <= 104 << 20
    docs = spark.createDataFrame([("en", "to be or not to be"), (None, "to be")] * 20, "lang string, text string")
    made, real = [], type(docs).mapInArrow

    def watched(df, f, *args, **kw):
        made.append(len(cloudpickle.dumps(f)))
        return real(df, f, *args, **kw)
    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    c = op12.Counter(docs, "lang", "text", 12, 3, 1, 1 << 22).run()
    assert len(made) > 3 and max(made) < 1 << 20 < max(t.cells.nbytes for t in c.tables if t)
    assert c.sent == [None] * 3  # what was broadcast is gone


@pytest.mark.parametrize("places, steps", [(1 << 17, 12), (1 << 17, 24), (1, 12)])
def test_table_of_steps(places, steps):
    rng = np.random.default_rng(5)
    rows = [rng.integers(1, 1 << 63, 3000, dtype=np.uint64) for _ in range(2)]
    entered = rng.integers(0, 9, 1000)
    table, unseen = op12.Steps(places, steps), 15 if steps < 16 else 255
    want = np.full(places, unseen)
    for step in range(9):
        some = [r[:1000][entered == step] for r in rows]
        hit = np.zeros(max(places, 1 << 15), bool)
        for r in (some, [op12.turned(x) for x in some]):
            hit[op12.slots(r, places)] = True
        for begin in range(0, len(hit), 1 << 15):
            table.enter(begin, hit[begin:begin + (1 << 15)], step)
        want[hit[:places] & (want == unseen)] = step
    assert (table.at(np.arange(places, dtype=np.uint64)) == want).all()
    got = table.reached(rows)
    assert (got[:1000] <= entered).all()
    if places > 1:
        assert (got[:1000] == entered).mean() > 0.99
        assert (got[1000:] == unseen).mean() > 0.99


def test_counts_reach_spark_in_small_batches(monkeypatch):
    monkeypatch.setattr(op12, "BATCH", 100)
    run = op12.Run(1)
    run.add("en", " ".join(f"w{i % 730}" for i in range(2000)).encode())
    out = list(op12.counted(run, 0, 3, [None] * 3))
    assert len(out) == 8 and max(b.num_rows for b in out) == 100
    assert Counter({w: n for b in out for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist())}) == \
        Counter(f"w{i % 730}" for i in range(2000))


def test_no_phrases(nothing):
    assert op12.phrases(nothing).collect() == []


# -- Arrow files ---------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(op13.tokenizer_path())


def _ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_words_get_the_ids_of_the_library(tokenizer):
    rnd = random.Random(2)
    marks = ["'s", "'LL", "don't", "É", "é", "é", "́", "H̱", "ß", "Σ", "ΟΔΟΣ", "İ", "×÷", "3.14", "...", " ",
             " ", "\x85", "\x1c", "\x00", "日本", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", "ÿÀ", "ªµ", "x" * 40]
    texts = ["".join(rnd.choice([*marks, " ", "\t", "\n", "a", "B", "7", "_"]) for _ in range(60)) for _ in range(300)]
    encoder = op13.WordEncoder(cache=50)
    for t in texts + ["", " ", *marks]:
        got = np.frombuffer(b"".join(encoder.ids(t.encode())), "<u2")
        assert got.tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_slices_of_a_long_text_give_the_ids_of_the_whole(tokenizer, monkeypatch):
    monkeypatch.setattr(op13, "SLICE", 100)
    text = " ".join(random.Random(1).choices(["Some", "words,", "été", "x" * 150, "\n"], k=800))
    encoder = op13.WordEncoder()
    assert np.frombuffer(b"".join(encoder.ids(text.encode())), "<u2").tolist() == _ids(tokenizer, text)[:-1].tolist()


def test_files_give_back_every_document(spark, docs, tokenizer, tmp_path, monkeypatch):
    manifest = op13.write(docs, str(tmp_path / "out"), length=64, partitions=4, file_tokens=20000).cache()
    got = op13.read_documents(manifest, docs.schema["doc_id"]).collect()
    want = Counter((d.doc_id, len(i := _ids(tokenizer, d.text)), zlib.crc32(i.tobytes())) for d in docs.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    # ascending ids, no gap
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    files = manifest.collect()
    assert len(files) > 4 and sum(f.n_docs for f in files) == docs.count()
    for f in files:
        s = op13.SequenceFile(f.uri)
        flat, real = [], 0
        for i in range(s.file.num_record_batches):
            batch, masks = s.batch(i)
            assert batch.shape[1] == 64 and not batch.flags.owndata and batch.dtype == np.uint16
            assert masks.type == pa.list_(pa.field("item", pa.bool_(), nullable=False), 64)
            flat.append(batch.reshape(-1))
            real += sum(masks.flatten().to_pylist())
        assert real == f.n_tokens
        flat = np.concatenate(flat)
        n = len(flat) // 64 - 1
        row, mask = s.sequence(n)
        assert row.tolist() == flat[64 * n:].tolist() and mask.true_count == f.n_tokens - 64 * n
        assert 0 <= len(flat) - f.n_tokens < 64 and not flat[f.n_tokens:].any()


def test_no_documents_no_files_and_text_ids(spark, nothing, tmp_path):
    assert op13.write(nothing, str(tmp_path / "none")).count() == 0
    named = spark.createDataFrame([("b", "two words", 1), ("a", None, 2), (None, "x", 3)], "name string, body string, start int")
    manifest = op13.write(named, str(tmp_path / "named"), "name", "body")
    got = op13.read_documents(manifest, T.StructField("name", T.StringType())).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in got) == [(0, None, 2), (2, "a", 1), (3, "b", 3)]
    assert math.isclose(manifest.agg(F.sum("n_tokens")).first()[0], 6)
