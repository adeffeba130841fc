"""Operator 8: removal of repeated word windows, by level-wise doubling.

A window is ``size`` consecutive words of a document; each word covered by a
window whose words also start anywhere else is removed. Windows are not all
counted. Levels of growing length leave fewer and fewer candidates:

1. Length ``k = ceil(size / 4)``. Of the k-grams in a window the one with the
   smallest hash (rightmost on ties) is its *anchor*. Equal windows have equal
   anchors at equal places, so only anchors are counted, about two for each
   ``size - k + 2`` words.
2. Length ``2 k``: an anchor that was repeated is extended to the right, or to
   the left for windows that end too early; those not repeated are done with.
3. Whole spans: an anchor left has one run of windows. Where all words of the
   run are repeated, so is each of its windows, and one document's stand for
   those of all.
4. Length ``size``: the windows of the other runs are compared among those
   with the same anchor, the standing ones included.

With no candidate left, a level is empty and nothing further happens. Each
occurrence is a row, keyed by the hash of its window. A level's keys are
counted by sums that begin before the shuffle; the repeated ones are staged and
find their rows by a join of two plain shuffles, in which Spark splits a key
that very many rows have. Hashes have 64 bits, and spans and windows of length
``size`` are only compared within an anchor: 128 bits. A level's shuffle files
go when its result is staged.

Documents are staged once, compressed, under a row number of that table.
Texts return to the places found by a join on the row number.

Defined results: null and empty texts have no words; a document shorter than
``size`` loses nothing; copies of a document lose everything (each window also
starts in the other copy); kept words are joined by one space; null ids pass
through; a very long text is hashed as a whole in its task; an empty table gives
no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_limits, documents, shuffles_dropped, stage
from ledgerline.llm.words import Words, chunks, span_hashes, window_hashes
from ledgerline.operators.sequence import discard

SIZE = 35
_U = np.uint64


def anchors(grams: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): places of the anchors of a document's windows,
    and the first and last start of the windows that each is anchor of."""
    width = size - k + 1  # k-grams in a window
    n = len(grams) - width + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    low = np.arange(len(grams))  # place of the least gram of each run, by doubling
    have = 1
    while have < width:
        step = min(have, width - have)
        a, b = low[:-step], low[step:]
        low = np.where(grams[a] < grams[b], a, b)
        have += step
    edge = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    return low[edge], edge, np.concatenate((edge[1:], [n])) - 1


def _bodies(column: pa.Array) -> list[bytes]:
    x = zstandard.ZstdDecompressor()
    return [x.decompress(z) for z in column.to_pylist()]


def _word_hashes(bodies: list[bytes]) -> Iterator[tuple[Words, int, np.ndarray]]:
    """(words of the chunk, number in the chunk, word hashes) per document."""
    for docs in chunks([b.decode("utf-8", "surrogatepass") for b in bodies]):
        w = Words(docs)
        hashes = w.hashes()
        for i in range(len(docs)):
            yield w, i, hashes[w.first[i]:w.first[i + 1]]


def staged_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, doc_id, body): the texts, compressed, under a row number."""
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([c.compress((t or "").encode("utf-8", "surrogatepass"))
                                                     for t in b.column(2).to_pylist()], pa.binary())],
                names=["doc", "doc_id", "body"])

    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return stage(rows.mapInArrow(squeeze, f"doc long, doc_id {kind}, body binary"), "windows-texts")


def first_level(texts: DataFrame, size: int, k: int) -> DataFrame:
    """(gram, ahead, behind, doc, place): anchors, with the hashes of the
    windows of length ``2 k`` that begin and end with them (0: not needed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], [], []]
            for doc, (_, _, words) in zip(b.column(0).to_pylist(), _word_hashes(_bodies(b.column(1)))):
                if len(words) < size:
                    continue
                grams, double = window_hashes(words, k), window_hashes(words, 2 * k)
                place, first, last = anchors(grams, size, k)
                # a window starting at s holds the forward double unless it
                # ends before; then it holds the backward one
                forward = last >= place - (size - 2 * k)
                backward = first < place - (size - 2 * k)
                end = len(double) - 1
                ahead = np.where(forward, double[np.minimum(place, end)], _U(0))
                behind = np.where(backward, double[np.clip(place - k, 0, end)], _U(0))
                for to, x in zip(out, (grams[place], ahead, behind, np.full(len(place), doc, np.int64), place)):
                    to.append(x)
            if out[0]:
                whole = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in whole[:4]] + [pa.array(whole[4].astype(np.int32))],
                    names=["gram", "ahead", "behind", "doc", "place"])

    return texts.select("doc", "body").mapInArrow(run, "gram long, ahead long, behind long, doc long, place int")


def anchor_counts(texts: DataFrame, size: int, k: int) -> DataFrame:
    """(gram, n): how often each gram is an anchor, summed within each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.empty(0, _U)]
            for _, _, words in _word_hashes(_bodies(b.column(0))):
                grams = window_hashes(words, k)
                found.append(grams[anchors(grams, size, k)[0]])
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))],
                                             names=["gram", "n"])

    return texts.select("body").mapInArrow(run, "gram long, n long")


def stage_repeated(rows: DataFrame, keys: list[str], tag: str, counts: DataFrame | None = None,
                   shape: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """The rows whose key another row has, too, in the form ``shape`` gives
    them, staged. ``counts`` (keys, n) may be given where they come cheaper."""
    if counts is None:
        counts = rows.select(*keys, F.lit(1).cast("long").alias("n"))
    more = stage(counts.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n > 1").select(*keys), "windows-repeated")
    out = stage(shape(rows.join(more, keys, "left_semi")), tag)
    discard(more)
    return out


def second_level(first: DataFrame) -> DataFrame:
    """(doc, found): anchors of each document one of whose extensions is
    repeated, as (place, side); side 1: to the right, 2: to the left."""
    sides = F.filter(F.array(F.struct(F.lit(1).alias("side"), F.col("ahead").alias("double")),
                             F.struct(F.lit(2).alias("side"), F.col("behind").alias("double"))),
                     lambda x: x["double"] != 0)
    rows = first.select("doc", "place", F.explode(sides).alias("x")) \
                .select("doc", "place", F.col("x.side").alias("side"), F.col("x.double").alias("double"))
    return stage_repeated(rows, ["side", "double"], "windows-doubled", shape=lambda found: found.groupBy("doc").agg(
        F.collect_list(F.struct("place", "side")).alias("found")))


def last_level(texts: DataFrame, found: DataFrame, size: int, k: int) -> DataFrame:
    """(doc, gram, span, start, hashes): for each anchor left, the windows of
    full length that may be repeated, and the hash of all words they cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "gram", "span", "start", "hashes"]

        def rows(out: list[list[np.ndarray]]) -> pa.RecordBatch:
            doc, gram, span, start, n, hashes = (np.concatenate(x) for x in out)
            bounds = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(gram.view(np.int64)), pa.array(span.view(np.int64)), pa.array(start.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes.view(np.int64)))], names=names)

        for b in batches:
            out, have = [[], [], [], [], [], []], 0
            places, sides = (c.to_numpy() for c in b.column(2).flatten().flatten())
            ends = np.cumsum(b.column(2).value_lengths().to_numpy()).tolist()
            for doc, begin, end, (_, _, words) in zip(b.column(0).to_pylist(), [0, *ends], ends, _word_hashes(_bodies(b.column(1)))):
                grams, full = window_hashes(words, k), window_hashes(words, size)
                place, first, last = anchors(grams, size, k)
                at, ahead = places[begin:end], sides[begin:end] == 1
                i = np.searchsorted(place, at)
                turn = at - (size - 2 * k)  # earlier starts need the left extension
                a = np.where(ahead, np.maximum(first[i], turn), first[i])
                z = np.where(ahead, last[i], np.minimum(last[i], turn - 1))
                n = z - a + 1
                windows = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                for to, x in zip(out, (np.full(len(at), doc, np.int64), grams[at], span_hashes(words, a, z + size), a, n, full[windows])):
                    to.append(x)
                have += len(at)
                if have > 1 << 15:
                    yield rows(out)
                    out, have = [[], [], [], [], [], []], 0
            if have:
                yield rows(out)

    pairs = texts.join(found.hint("merge"), "doc").select("doc", "body", "found")
    return pairs.mapInArrow(run, "doc long, gram long, span long, start int, hashes array<long>")


def span_level(last: DataFrame) -> DataFrame:
    """(doc, gram, start, n, repeated, hashes), staged: the runs of ``n``
    windows from ``start``, and whether another run has the same words.
    ``hashes`` of the runs that are not repeated and, of those that are, in the
    document of the least number."""
    keys = ["gram", "span"]
    more = stage(last.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least"))
                     .filter("n > 1").select(*keys, "least"), "windows-repeated")
    out = stage(last.join(more, keys, "left").select(
        "doc", "gram", "start", F.size("hashes").alias("n"), F.col("least").isNotNull().alias("repeated"),
        F.when(F.coalesce(F.col("least") == F.col("doc"), F.lit(True)), F.col("hashes")).alias("hashes")), "windows-spans")
    discard(more)
    return out


def repeated_starts(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc, starts): runs of the windows of each document that are repeated,
    as (start, n), staged. A level's table goes when the next one is written."""
    k = -(-size // 4)
    first = stage_repeated(first_level(texts, size, k), ["gram"], "windows-anchors", anchor_counts(texts, size, k))
    found = second_level(first)
    discard(first)
    last = stage(last_level(texts, found, size, k), "windows-whole")
    discard(found)
    spans = span_level(last)
    discard(last)
    windows = spans.select("gram", "doc", "repeated", F.posexplode("hashes").alias("i", "window"), "start") \
                   .select("gram", "window", "doc", "repeated", (F.col("start") + F.col("i")).alias("start"))
    counts = windows.select("gram", "window", F.lit(1).cast("long").alias("n"))
    whole = spans.filter("repeated").select("doc", "start", "n")
    starts = stage_repeated(
        windows.filter("not repeated").drop("repeated"), ["gram", "window"], "windows-starts", counts,
        shape=lambda found: found.select("doc", "start", F.lit(1).alias("n")).unionByName(whole).groupBy("doc").agg(
            F.collect_list(F.struct("start", "n")).alias("starts")))
    discard(spans)
    return starts


def removed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, spans): ``kept`` is the
    text left, ``spans`` the word ranges removed, as [first, after last]."""
    if size < 4:
        raise ValueError("windows of at least 4 words")
    arrow_limits(docs.sparkSession)
    texts = staged_documents(docs, id_col, text_col)
    with shuffles_dropped(docs.sparkSession):
        starts = repeated_starts(texts, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], [], []]
            begins, runs = (c.to_numpy() for c in b.column("starts").flatten().flatten())
            ends = np.cumsum(b.column("starts").value_lengths().fill_null(0).to_numpy()).tolist()
            for begin, end, (w, i, words) in zip([0, *ends], ends, _word_hashes(_bodies(b.column("body")))):
                n = len(words)
                change = np.zeros(n + 1, np.int64)
                if end > begin:
                    at = begins[begin:end]
                    change += np.bincount(at, minlength=n + 1)
                    change -= np.bincount(at + runs[begin:end] - 1 + size, minlength=n + 1)
                gone = np.cumsum(change)[:n] > 0
                base = w.first[i]
                kept = b" ".join([w.raw[w.start[base + j]:w.end[base + j]] for j in np.flatnonzero(~gone).tolist()])
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))).reshape(-1, 2)
                for to, x in zip(out, (n, int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                                       kept.decode("utf-8", "replace"), edge.tolist())):
                    to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.join(starts.hint("merge"), "doc", "left").select("doc_id", "body", "starts")
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string,"
                                " kept string, spans array<array<long>>")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = rf"""
WITH lists AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + {SIZE - 1}], ' ')) AS h
  FROM lists, LATERAL unnest(range(1, len(ws) - {SIZE - 2})) AS g(s)),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, s + step AS place FROM windows JOIN repeated USING (h), range({SIZE}) AS r(step)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM lists),
told AS (
  SELECT w.doc_id, count(g.place) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.place) FILTER (WHERE g.place IS NULL), '') AS kept
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.place = w.place GROUP BY w.doc_id)
SELECT l.doc_id, len(l.ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM lists l LEFT JOIN told USING (doc_id)
"""
