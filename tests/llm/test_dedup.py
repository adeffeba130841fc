"""Exact, line, near-duplicate and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import op2_stream_dedup as op2
from ledgerline.llm import op3_line_templates as op3
from ledgerline.llm import op7_parity_join as op7
from ledgerline.llm import op8_substring_dedup as op8

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- exact ----------------------------------------------------------------
def _groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    return groups


def _check_exact(docs, got):
    groups = _groups(docs.collect())
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[i, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    rows = got.collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact(spark, docs, table):
    _check_exact(docs, op2.dedup_stream(spark, f"{table}/documents.parquet"))


def test_exact_with_colliding_keys(spark, docs, table):
    got = op2.dedup_stream(spark, f"{table}/documents.parquet", key=lambda d: d.substr(1, 1), files_per_batch=1)
    _check_exact(docs, got)


def test_exact_adds_new_files_to_the_state(spark, docs, tmp_path):
    path, work = str(tmp_path / "documents.parquet"), str(tmp_path / "work")
    docs.filter("d % 2 = 0").write.parquet(path)
    op2.dedup_stream(spark, path, work).count()
    before = spark.read.parquet(f"{work}/arrivals").count()
    docs.filter("d % 2 = 1").write.mode("append").parquet(path)
    _check_exact(docs, op2.dedup_stream(spark, path, work))
    assert 0 < before < docs.count() == spark.read.parquet(f"{work}/arrivals").count()


def test_exact_empty(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "e.parquet"))
    assert op2.dedup_stream(spark, str(tmp_path / "e.parquet")).collect() == []


# -- lines ----------------------------------------------------------------
def test_lines(spark):
    texts = {i: " ".join(chr(97 + i) * j for j in range(2, 8)) + f"\nserved from host {i} in {i * 7} ms today\nshort one\nlast" for i in range(8)}
    rows = [(i, t, "en", "s", len(t), "x") for i, t in texts.items()] + [(8, None, "en", "s", None, "x"), (9, "", "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, line string")
    got = {r.doc_id: r for r in op3.drop_lines(docs).collect()}
    assert got[0].text == texts[0] and got[0].lines_gone == 0  # the first keeps the template
    for i in range(1, 8):
        assert got[i].text == "\n".join(x for x in texts[i].split("\n") if not x.startswith("served"))
        assert (got[i].lines_gone, got[i].n_chars) == (1, len(got[i].text))
    assert got[8].text is None and got[9].text == "" and got[8].n_chars is None
    assert op3.drop_boilerplate(spark, docs, "").columns == docs.columns


def test_lines_below_the_threshold_and_unlike_lines_stay(spark):
    few = [(i, "served from host 1 in 2 ms today") for i in range(op3.MIN_DOCS - 1)]
    # same leaf, but no majority at most places
    unlike = [(100 + i, "one two three " + " ".join(random.Random(i).choices("abcdefghijklmnop", k=6))) for i in range(9)]
    docs = spark.createDataFrame(few + unlike, "doc_id long, text string")
    assert all(r.lines_gone == 0 for r in op3.drop_lines(docs).collect())


def test_short_unlike_lines_with_equal_leading_words_stay(spark):
    lines = [f"was that so. {' '.join(chr(97 + i) * (j + 2) for j in range(n))}" for n in (1, 2, 3) for i in range(12)]
    # a variable is no sign of likeness either
    lines += [f"was that so. {i} {chr(97 + i) * 2} {i + 1}" for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.text for r in op3.drop_lines(docs).collect()} == set(lines)
    # repeats of one of them go, but for the first, and the others stay
    more = list(enumerate(lines)) + [(100 + i, lines[0]) for i in range(40)]
    got = {r.doc_id: r.lines_gone for r in op3.drop_lines(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    assert all(got[i] == (i >= 100) for i, _ in more)


def test_lines_with_a_place_that_varies_go(spark):
    lines = [f"you are user {i} of our site {chr(97 + i) * 3} since today" for i in range(9)]
    got = op3.drop_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert all(r.lines_gone == (r.doc_id > 0) for r in got)


def test_short_lines_that_recur_go(spark):
    def text(i):
        lines = [f"{chr(97 + i % 26)}{chr(97 + i // 26)} is a line of its own here", f"prose{chr(97 + i % 26)}"]
        lines += ["All rights reserved.", f"Page {i}", str(i)] if i % 3 == 0 else []
        return "\n".join(lines + ["And then."] * (i < 19) + ["Yes."] * (i % 13 == 0) + ["Menu"] * (i % 4 == 0))
    texts = {i: text(i) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in op3.drop_lines(docs).collect()}
    # "Yes." is in 24 documents of 300, too few for one word, "And then." in
    # fewer than SHORT_DOCS; numbers of their own are no repeats
    gone = re.compile("All rights reserved[.]|Page [0-9]+|Menu")
    for i, t in texts.items():
        assert got[i] == "\n".join(x for x in t.split("\n") if i == 0 or not gone.fullmatch(x))


def test_lines_edges(spark, docs, nothing):
    got = op3.drop_lines(docs)
    assert got.columns == docs.columns + ["lines_gone"] and got.count() == docs.count()
    assert op3.drop_lines(nothing).count() == 0


# -- near duplicates --------------------------------------------------------
def _shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def _components(rows):
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    best = {r: min([k for k in ks if k is not None], default=None) for r, ks in least.items()}
    return Counter((k, len(s), best[find(i)] if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def _family(seed, size, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        yield " ".join(own)


def _near(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op7.components_of(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components(rows)


def test_near_duplicates(spark, docs):
    _near(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_near_duplicates_large_groups(spark):
    """Groups with more sets than a rare key may have: at, above and below the
    similarity, so that later rounds and the exhaustive one are needed."""
    texts = [*_family(1, 60, 150, 3), *_family(2, 40, 300, 9), *_family(3, 50, 60, 1)]
    random.Random(5).shuffle(texts)
    shared = " ".join(f"p{i}" for i in range(40))  # one passage in many unlike texts
    texts += [shared + " " + t for t in (" ".join(f"q{i}_{j}" for j in range(30 + i)) for i in range(40))]
    _near(spark, [(i * 3, t) for i, t in enumerate(texts)] + [(2, texts[0]), (None, texts[1])])


def test_near_duplicates_empty(spark, nothing):
    assert op7.components_of(nothing).count() == 0


@pytest.mark.parametrize("n", [4, 5, 9, 21, 80, 400, 1500])
def test_linking_sets_share_the_promised_keys(n):
    rng = np.random.default_rng(n)
    table = op7.bands()
    for _ in range(20):
        both = int(rng.integers(max(1, (4 * n) // 5), n + 1))
        extra = int(rng.integers(0, both // 4 + 1 - min(both // 4, n - both)))
        tokens = np.unique(rng.integers(0, 1 << 64, n + extra, dtype=np.uint64))
        a, b = np.sort(tokens[:n]), np.sort(np.concatenate((tokens[:both], tokens[n:])))
        if 100 * both < 80 * (len(a) + len(b) - both) or len(a) + len(b) == 2 * both:
            continue
        ka = {g: (set(k.tolist()), left) for g, k, left in op7.sketch_keys(a, table)}
        kb = {g: (set(k.tolist()), left) for g, k, left in op7.sketch_keys(b, table)}
        low = min(len(a), len(b))
        g = next(i for i, t in enumerate(table) if t[0] <= low < t[1])
        assert len(ka[g][0] & kb[g][0]) >= max(1, ka[g][1], kb[g][1])


@pytest.mark.parametrize("n", [1, 9, 80, 700, 4000])
def test_brief_sketches_are_no_further_apart_than_the_sets(n):
    rng = np.random.default_rng(n)
    for apart in (0, 1, n // 3, n):
        tokens = rng.integers(0, 1 << 64, n + apart, dtype=np.uint64)
        a, b = np.sort(tokens[:n]), np.sort(tokens[apart:])
        x, y = op7.brief_sketch(a).view(np.uint64), op7.brief_sketch(b).view(np.uint64)
        assert len(x) == len(op7.BRIEF) and np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_whole_sketches_are_compared_after_brief_ones_only(spark, docs):
    """The exhaustive round gives the pairs whose whole sketches are near; of
    the others, most are left out by columns that are compiled."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[k % 40:], rng.integers(0, 1 << 64, k % 30, dtype=np.uint64)))) for k in range(60)]
    bodies = spark.createDataFrame(
        [(d, op7.whole_sketch(s).tolist(), *op7.brief_sketch(s).tolist()) for d, s in enumerate(sets)],
        "d long, sketch array<long>, " + ", ".join(f"{c} long" for c in op7.BRIEF))
    table = op7.bands()
    band = next(i for i, t in enumerate(table) if t[0] <= 80 < t[1])
    rows = spark.createDataFrame([(7, band, d, len(s), d) for d, s in enumerate(sets)],
                                 "key long, band int, d long, n long, comp long")
    out = op7.ParityJoin(docs).open_pairs(rows, bodies)

    def apart(a, b):
        x, y = op7.whole_sketch(a), op7.whole_sketch(b)
        if len(x) < len(y):
            x, y = y, x
        while len(x) > len(y):
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
        return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())

    fits = lambda a, b: min(a, b) < table[band][1] and 100 * min(a, b) >= 80 * max(a, b)
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j])
            if fits(len(a), len(b)) and 180 * apart(a, b) <= 20 * (len(a) + len(b))}
    assert {tuple(r) for r in out.collect()} == want and 0 < len(want) < 60 * 59 // 2
    join = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x)
    assert 0 < join.index("bit_count((brief0") < join.index("aggregate(")


def test_one_of_each_stays(spark, docs):
    kept = op7.keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    want = _components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    full = {c for (k, n, c) in want if n}
    got = [r.doc_id for r in kept.collect() if _shingles(r.text)]
    assert Counter(got) == Counter(full)


# -- substrings -------------------------------------------------------------
def _windows(rows, size):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    for (k, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        yield k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept


@pytest.mark.parametrize("size", [4, 7, 35])
def test_substrings(spark, docs, size):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(size)
    for i in range(30):  # passages on both sides of the window's length, and loops
        passage = [f"s{rng.randrange(4)}" for _ in range(size + i % 5 - 2)]
        rows += [(10_000 + 2 * i + j, " ".join([f"u{i}{j}{k}" for k in range(j * 9)] + passage + [f"v{i}{j}"])) for j in (0, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in op8.removed_words(frame, size=size).collect())
    assert got == Counter(_windows(rows, size))


def test_substrings_edges(spark, nothing):
    assert op8.removed_words(nothing).count() == 0
    with pytest.raises(ValueError):
        op8.removed_words(nothing, size=3)


def _copies(n):
    """Copies of a text, parts of it that begin and end anywhere, and a loop."""
    rng = random.Random(n)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    rows = [(i, " ".join(words)) for i in range(n)]
    for i in range(40):
        at = rng.randrange(300)
        rows.append((1000 + i, " ".join([f"a{i}", *words[at:at + 33 + i % 12], f"b{i}"])))
    return rows + [(2000, "p q r " * 60), (2001, "x y z " * 11 + "end " + "x y z " * 12)]


@pytest.mark.parametrize("size", [7, 35])
def test_substrings_of_copies(spark, size, monkeypatch):
    compared, plain = [], op8.stage_repeated

    def counted(rows, keys, tag, *args, **named):
        if "window" in keys:
            compared.append(rows.count())
        return plain(rows, keys, tag, *args, **named)

    monkeypatch.setattr(op8, "stage_repeated", counted)
    rows = _copies(50)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in op8.removed_words(frame, size=size).collect())
    assert got == Counter(_windows(rows, size))
    assert compared[0] < 3000  # the windows of 50 copies are not rows: 18,705 and more were


def test_substrings_leave_no_shuffle_files(spark):
    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {x.getName() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())
                if x.getName().startswith("shuffle_")}

    frame = spark.createDataFrame(_copies(5), "doc_id long, text string")
    before = files()
    op8.removed_words(frame)
    assert not files() - before
