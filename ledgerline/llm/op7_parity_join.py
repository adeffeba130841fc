"""Operator 7: n-gram Jaccard join with parity sketches.

A document's set holds the 64-bit hashes of its distinct shingles of ``WORDS``
words. Sets A and B link when ``100 * |A and B| >= percent * |A or B|``, that
is when their symmetric difference is at most a fixed share of ``|A| + |B|``.

*Sketch.* The tokens of a set are dealt by hash to K parts and XORed within
each part. A token of the symmetric difference changes one part at most, so
the number of unequal parts is a lower bound of the difference. Sets are
joined in *size bands*: band g holds sizes ``[l, h)`` and is joined with itself
and with the larger sizes that ``h - 1`` can link to. In it a linking pair
differs by D tokens at most, and with ``K > D`` parts it has ``K - D`` equal
parts at least: a set is found under the key (band, part, XOR value).

Keys that say little are left out where the pigeonhole allows it, without
losing a link. With e empty parts, a set has ``K - D - e`` equal parts that
aren't empty, with h of its keys *common* (shared by more than ``COMMON``
different sets) ``K - D - e - h`` rare ones. If that number is positive, so
many rare keys must be shared, and only pairs with as many are verified. A set
for which it isn't is *saturated*: two saturated sets are compared under their
common keys (and, if empty parts alone use up ``K - D``, under keys of empty
parts too). Rare keys have ``COMMON`` sets at most, so their pairs grow with
the input.

*Large groups.* Under a common key not all pairs are made. Each member is
verified against one of the group, another one in each round, and only while
the two aren't in one component yet. What is left after ``ROUNDS`` rounds is
compared exhaustively: all pairs of different components whose brief sketches
(512 bits) and then whole parity sketches (``BITS`` bits per token) are within
the bound; in a join condition, so that only those leave the join.

Equal sets are one class; only classes are joined, and copies within a task
are left out before the shuffle. Verification computes both sets from the
texts again. Set elements, classes and rows are told by 64-bit hashes: among
n of them ``n * n / 2**65`` false matches are to be expected.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; fewer
than ``WORDS`` words are one shingle; without words or with null text the set
is empty and links with nothing; ``component_id`` is the smallest id of the
component, null ids are passed over (all null: null); repeated rows are linked;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_limits, documents, stage
from ledgerline.llm.words import Words, chunks, mix, window_hashes

WORDS = 5
PERCENT = 80
STEP = 1.5625     # size ratio of neighbouring bands
SLACK = 1.3       # parts for each token that may differ
COMMON = 16       # different sets under a rare key, at most
ROUNDS = 3
BITS = 8          # of the whole sketch, for each token
BRIEF = [f"brief{i}" for i in range(8)]  # columns of a sketch of fixed length, 64 bits each
_U = np.uint64
_BAND = 63        # the lowest bits of a key hold the band


def bands(percent: int = PERCENT, top: int = 1 << 40) -> list[tuple[int, int, int, int, int]]:
    """(l, h, largest partner, D, K) of each band."""
    out, low = [], 1
    while low < top and len(out) <= _BAND:
        high = max(low + 1, int(low * STEP))
        reach = (high - 1) * 100 // percent
        most = (high - 1 + reach) * (100 - percent) // (100 + percent)
        out.append((low, high, reach, most, int(np.ceil(SLACK * (most + 1))) + 2))
        low = high
    return out


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for docs in chunks(texts):
        w = Words(docs, lower=True)
        hashes = w.hashes()
        full = window_hashes(hashes, words)
        for a, b in zip(w.first[:-1], w.first[1:]):
            if b - a >= words:
                yield np.unique(full[a:b - words + 1])
            else:
                yield window_hashes(hashes[a:b], b - a) if b > a else full[:0]


def digest(tokens: np.ndarray) -> int:
    """64-bit name of a set."""
    mixed = mix(tokens + _U(0x5851F42D4C957F2D))
    total = np.array([len(tokens)], _U) + np.bitwise_xor.reduce(mixed) + mix(tokens.sum(keepdims=True, dtype=_U))
    return int(mix(total).view(np.int64)[0])


def sketch_keys(tokens: np.ndarray, table: list[tuple]) -> Iterator[tuple[int, np.ndarray, int]]:
    """(band, keys, K - D - e) for each band that the set takes part in."""
    n = len(tokens)
    for g, (low, high, reach, most, parts) in enumerate(table):
        if low > n:
            return
        if n <= max(reach, high - 1) and most:
            part = ((tokens >> _U(20)) % _U(parts)).astype(np.int64)
            value = np.zeros(parts, _U)
            np.bitwise_xor.at(value, part, tokens)
            used = np.flatnonzero(np.bincount(part, minlength=parts))
            left = len(used) - most
            if left <= 0:
                used = np.arange(parts)  # empty parts too
            named = mix(value[used] ^ mix(used.astype(_U) + _U((g + 1) << 32)))
            yield g, ((named & ~_U(_BAND)) | _U(g)).view(np.int64), max(left, 0)


def whole_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens over a power of two of bits; halves can be XORed
    to get the sketch of half the length."""
    return _parity(tokens, 1 << max(0, (len(tokens) * BITS - 1).bit_length() - 6))


def brief_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens over ``len(BRIEF)`` times 64 bits, whatever the
    size of the set: the distance of two is a lower bound, too."""
    return _parity(tokens, len(BRIEF))


def _parity(tokens: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words, _U)
    np.bitwise_xor.at(out, ((tokens >> _U(6)) % _U(words)).astype(np.int64), _U(1) << (tokens & _U(63)))
    return out.view(np.int64)


def _apart(a: str, b: str) -> str:
    """SQL: Hamming distance of two whole sketches, the longer one folded."""
    def ham(x, y):
        return f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"

    def half(x):
        return (f"zip_with(slice({x}, 1, cast(size({x}) / 2 as int)),"
                f" slice({x}, cast(size({x}) / 2 as int) + 1, cast(size({x}) / 2 as int)), (p, q) -> p ^ q)")

    return (f"case when size({a}) = size({b}) then {ham(a, b)}"
            f" when size({a}) = 2 * size({b}) then {ham(half(a), b)}"
            f" when size({b}) = 2 * size({a}) then {ham(a, half(b))} else 0 end")


class ParityJoin:
    """The join over one table; every step is staged in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = WORDS, percent: int = PERCENT):
        arrow_limits(docs.sparkSession)
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                                F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"))
        self.words, self.percent, self.table = words, percent, bands(percent)

    # -- sets and sketches -------------------------------------------------
    def sets(self) -> DataFrame:
        """(doc_id, row_key, n, d, band, left) of every row; d: its class."""
        words, table = self.words, self.table

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, d, band, left = [], [], [], []
                for tokens in shingle_sets(b.column("text").to_pylist(), words):
                    n.append(len(tokens))
                    d.append(digest(tokens) if len(tokens) else None)
                    each = [(g, room) for g, _, room in sketch_keys(tokens, table)] if len(tokens) else []
                    band.append([g for g, _ in each])
                    left.append([room for _, room in each])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("row_key"), pa.array(n, pa.int64()), pa.array(d, pa.int64()),
                     pa.array(band, pa.list_(pa.int32())), pa.array(left, pa.list_(pa.int32()))],
                    names=["doc_id", "row_key", "n", "d", "band", "left"])

        kind = self.docs.schema["doc_id"].dataType.simpleString()
        return self.docs.select("doc_id", "row_key", "text").mapInArrow(
            run, f"doc_id {kind}, row_key long, n long, d long, band array<int>, left array<int>")

    def keys(self) -> DataFrame:
        """(key, d): the sketch keys of each class, once per task at most."""
        words, table = self.words, self.table

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for b in batches:
                keys, names = [], []
                for tokens in shingle_sets(b.column(0).to_pylist(), words):
                    if len(tokens) and (d := digest(tokens)) not in seen:
                        seen.add(d)
                        for _, k, _ in sketch_keys(tokens, table):
                            keys.append(k)
                            names.append(np.full(len(k), d))
                if keys:
                    k, d = np.concatenate(keys), np.concatenate(names)
                    for at in range(0, len(k), 1 << 16):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(k[at:at + (1 << 16)]), pa.array(d[at:at + (1 << 16)])], names=["key", "d"])

        return self.docs.select("text").mapInArrow(run, "key long, d long")

    def shared(self) -> DataFrame:
        """(key, d, sets): the keys that two classes or more have. Rows of a
        key are sorted and streamed, never held together."""
        alike = Window.partitionBy("key")
        two = self.keys().withColumn("lo", F.min("d").over(alike)).withColumn("hi", F.max("d").over(alike)) \
                  .filter("lo < hi").select("key", "d")
        order = alike.orderBy("d")
        once = two.withColumn("before", F.lag("d").over(order)).filter("before is null or before != d")
        return once.select("key", "d", F.count(F.lit(1)).over(alike).alias("sets"))

    def bodies(self, wanted: DataFrame) -> DataFrame:
        """(d, n, body, sketch, brief0, ...) of the classes in ``wanted``;
        ``body``: the text of one row of the class, compressed."""
        words = self.words

        def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = zstandard.ZstdCompressor(level=3)
            for b in batches:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([c.compress((t or "").encode("utf-8", "surrogatepass"))
                                            for t in b.column(1).to_pylist()], pa.binary())],
                    names=["row_key", "body"])

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = zstandard.ZstdDecompressor()
            for b in batches:
                texts = [x.decompress(z).decode("utf-8", "surrogatepass") for z in b.column("body").to_pylist()]
                sets = list(shingle_sets(texts, words))
                brief = np.array([brief_sketch(s) for s in sets], np.int64).reshape(-1, len(BRIEF))
                yield pa.RecordBatch.from_arrays(
                    [b.column("d"), pa.array([len(s) for s in sets], pa.int64()), b.column("body"),
                     pa.array([whole_sketch(s) for s in sets], pa.list_(pa.int64()))]
                    + [pa.array(c) for c in brief.T.copy()],
                    names=["d", "n", "body", "sketch", *BRIEF])

        one = self.meta.join(wanted, "d", "left_semi").groupBy("d").agg(F.min("row_key").alias("row_key"))
        packed = self.docs.select("row_key", "text").mapInArrow(squeeze, "row_key long, body binary")
        found = packed.join(one.hint("merge"), "row_key").select("d", "body").dropDuplicates(["d"])
        return found.mapInArrow(draw, "d long, n long, body binary, sketch array<long>, "
                                + ", ".join(f"{c} long" for c in BRIEF))

    # -- candidates --------------------------------------------------------
    def needs(self, shared: DataFrame) -> DataFrame:
        """(d, band, n, need): rare keys that a linking pair must share; 0 or
        less: the class is saturated."""
        each = self.meta.filter("n > 0").select("d", "n", F.explode(F.arrays_zip("band", "left")).alias("x")) \
                   .select("d", "n", F.col("x.band").alias("band"), F.col("x.left").alias("left")).dropDuplicates(["d", "band"])
        here = shared.groupBy("d", self._band().alias("band")) \
                     .agg(F.count_if(F.col("sets") > COMMON).alias("common"))
        return here.join(each, ["d", "band"]).select("d", "band", "n", (F.col("left") - F.col("common")).alias("need"))

    @staticmethod
    def _band() -> Column:
        return F.col("key").bitwiseAND(F.lit(_BAND).cast("long")).cast("int")

    def _sizes_fit(self, a: str, b: str, band: str) -> Column:
        """The smaller of the two sizes is in the band, and they may link."""
        highs = F.array(*[F.lit(t[1]).cast("long") for t in self.table])
        small, large = F.least(a, b), F.greatest(a, b)
        return (small < F.element_at(highs, F.col(band) + 1)) & (100 * small >= self.percent * large)

    def rare_pairs(self, rows: DataFrame) -> DataFrame:
        """(a, b) of classes that share as many rare keys as they must."""
        mine = rows.filter(F.col("sets") <= COMMON)
        a = mine.select("key", "band", F.col("d").alias("a"), F.col("n").alias("na"), F.col("need").alias("xa"))
        b = mine.select("key", F.col("d").alias("b"), F.col("n").alias("nb"), F.col("need").alias("xb"))
        pairs = a.join(b, "key").filter(F.col("a") < F.col("b")).filter(self._sizes_fit("na", "nb", "band"))
        return pairs.groupBy("a", "b", "band").agg(F.count(F.lit(1)).alias("keys"), F.max("xa").alias("xa"), F.max("xb").alias("xb")) \
                    .filter(F.col("keys") >= F.greatest("xa", "xb")).select("a", "b").distinct()

    @staticmethod
    def mixed(rows: DataFrame, comps: DataFrame) -> DataFrame:
        """(key, band, d, n, comp): the rows of keys whose classes aren't all
        in one component yet."""
        named = rows.select("key", "band", "d", "n").join(comps, "d", "left").withColumn("comp", F.coalesce("comp", "d"))
        keys = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
        return named.join(keys.select("key"), "key", "left_semi").select("key", "band", "d", "n", "comp")

    def star_pairs(self, rows: DataFrame, turn: int) -> DataFrame:
        """(a, b): each class under a common key with one class of that key,
        if their sizes fit and they aren't in one component yet."""
        rank = F.struct(F.xxhash64(F.lit(turn), "d").alias("r"), F.col("d"), F.col("n"), F.col("comp"))
        heads = rows.groupBy("key").agg(F.min(rank).alias("head"))
        pairs = rows.join(heads, "key").select("d", "n", "comp", "band", "head.*", "head").toDF(
            "d", "n", "comp", "band", "r", "hd", "hn", "hcomp", "head")
        return pairs.filter((F.col("comp") != F.col("hcomp")) & self._sizes_fit("n", "hn", "band")) \
                    .select(F.least("d", "hd").alias("a"), F.greatest("d", "hd").alias("b")).distinct()

    def open_pairs(self, rows: DataFrame, bodies: DataFrame) -> DataFrame:
        """(a, b): all pairs under common keys that are in different
        components and whose whole sketches are near enough. These are only
        compared where the brief ones, whose distance is compiled, are near."""
        mine = stage(rows.join(bodies.select("d", "sketch", *BRIEF), "d"), "parity-open")
        a, b = mine.alias("a"), mine.alias("b")

        def within(apart: str) -> Column:
            return F.expr(f"({apart}) * {100 + self.percent} <= (a.n + b.n) * {100 - self.percent}")

        near = within(" + ".join(f"bit_count(a.{c} ^ b.{c})" for c in BRIEF)) & within(_apart("a.sketch", "b.sketch"))
        on = (F.col("a.key") == F.col("b.key")) & (F.col("a.d") < F.col("b.d")) \
            & (F.col("a.comp") != F.col("b.comp")) & self._sizes_fit("a.n", "b.n", "a.band") & near
        return a.join(b, on).select(F.col("a.d").alias("a"), F.col("b.d").alias("b")).distinct()

    # -- verification and components ---------------------------------------
    def verified(self, pairs: DataFrame, bodies: DataFrame) -> DataFrame:
        """The pairs that link, by their sets."""
        words, percent = self.words, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = zstandard.ZstdDecompressor()
            last, theirs = None, None

            def tokens(z: bytes) -> np.ndarray:
                return next(shingle_sets([x.decompress(z).decode("utf-8", "surrogatepass")], words))

            for batch in batches:
                out = []
                for a, b, za, zb in zip(*(c.to_pylist() for c in batch.columns)):
                    if b != last:
                        last, theirs = b, tokens(zb)
                    mine = tokens(za)
                    both = len(np.intersect1d(mine, theirs, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(theirs) - both):
                        out.append((a, b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        left = pairs.join(bodies.select(F.col("d").alias("a"), F.col("body").alias("za")), "a")
        both = left.join(bodies.select(F.col("d").alias("b"), F.col("body").alias("zb")), "b")
        return both.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")

    def join(self) -> DataFrame:
        """(doc_id, row_key, n_shingles, group): ``group`` names the component
        of the row's class, null for an empty set."""
        self.meta = stage(self.sets(), "parity-sets")
        shared = stage(self.shared(), "parity-shared")
        rows = stage(shared.withColumn("band", self._band()).join(self.needs(shared), ["d", "band"]), "parity-rows")
        hot = rows.filter((F.col("sets") > COMMON) & (F.col("need") <= 0)).select("key", "band", "d", "n")
        pairs = stage(self.rare_pairs(rows).unionByName(self.star_pairs(hot.withColumn("comp", F.col("d")), 0)).distinct(), "parity-pairs")
        wanted = pairs.select(F.col("a").alias("d")).unionByName(pairs.select(F.col("b").alias("d"))) \
                      .unionByName(hot.select("d")).distinct()
        bodies = stage(self.bodies(wanted), "parity-bodies")
        links = stage(self.verified(pairs, bodies), "parity-links")
        comps = components(links)
        tested = pairs
        for turn in range(1, ROUNDS + 1):
            hot = stage(self.mixed(hot, comps), "parity-hot")  # fewer in each round
            if hot.isEmpty():
                break
            more = self.star_pairs(hot, turn) if turn < ROUNDS else self.open_pairs(hot, bodies)
            more = stage(more.join(tested, ["a", "b"], "left_anti"), "parity-pairs")
            if more.isEmpty():
                continue
            tested = tested.unionByName(more)
            found = stage(self.verified(more, bodies), "parity-links")
            if not found.isEmpty():
                links = links.unionByName(found)
                comps = components(links, comps)
        group = F.when(F.col("n") > 0, F.coalesce("comp", "d"))
        return self.meta.join(comps, "d", "left").select("doc_id", "row_key", F.col("n").alias("n_shingles"),
                                                         group.alias("group"))


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(d, comp) of all linked nodes, comp: the smallest node of the component.
    Each round takes the smallest label among neighbours and then the label of
    the label, so that long chains shorten by half."""
    edges = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "parity-edges")
    nodes = edges.select(F.col("a").alias("d")).distinct()
    labels = nodes.withColumn("comp", F.col("d")) if known is None else \
        nodes.join(known, "d", "left").withColumn("comp", F.coalesce("comp", "d"))
    labels = stage(labels, "parity-labels")
    while True:
        there = edges.join(labels.select(F.col("d").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("best"))
        near = labels.join(there, labels["d"] == there["a"]).select("d", "comp", F.least("comp", "best").alias("best"))
        near = stage(near, "parity-labels")
        # whoever carries the old label hears of the smaller one, too
        heard = near.filter("best < comp").groupBy(F.col("comp").alias("old")).agg(F.min("best").alias("newer"))
        jump = near.select(F.col("d").alias("root"), F.col("best").alias("up"))
        step = near.join(heard, F.col("comp") == F.col("old"), "left") \
                   .withColumn("best", F.least("best", F.coalesce("newer", "best"))) \
                   .join(jump, F.col("best") == F.col("root"), "left") \
                   .select("d", "comp", F.least("best", F.coalesce("up", "best")).alias("best"))
        step = stage(step, "parity-labels")
        done = step.filter("best < comp").isEmpty()
        labels = step.select("d", F.col("best").alias("comp"))
        if done:
            return labels


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    rows = stage(ParityJoin(docs, id_col, text_col, words, percent).join(), "parity-groups")
    least = stage(rows.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("least")), "parity-least")
    return rows.join(least, "group", "left").select(
        "doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(documents(spark, sf_dir))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id
    stays (null ids last), and all documents with an empty set; of fully
    equal rows one stays."""
    rows = stage(ParityJoin(docs).join(), "parity-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    kept = rows.filter("group is not null").groupBy("group").agg(first).select(F.col("first.row_key").alias("parity_key")) \
               .unionByName(rows.filter("group is null").select(F.col("row_key").alias("parity_key"))).distinct()
    kept = stage(kept, "parity-kept")
    return docs.withColumn("parity_row", F.xxhash64("doc_id", "text")) \
               .join(kept.hint("merge"), F.col("parity_row") == F.col("parity_key"), "left_semi") \
               .dropDuplicates(["parity_row"]).select(*docs.columns)


SQL = rf"""
WITH RECURSIVE lists AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct([array_to_string(ws[i:i + {WORDS - 1}], ' ') FOR i IN range(1, len(ws) - {WORDS - 2})]) END AS tokens
  FROM lists),
-- documents of one set are one class
named AS (SELECT doc_id, len(tokens) AS n, md5(array_to_string(list_sort(tokens), chr(10))) AS class, tokens FROM sets),
classes AS (SELECT class, any_value(n) AS n, any_value(tokens) AS tokens FROM named WHERE n > 0 GROUP BY class),
spread AS (SELECT class, n, unnest(tokens) AS token FROM classes),
links AS (
  SELECT a.class AS a, b.class AS b
  FROM spread a JOIN spread b ON a.token = b.token AND a.class <> b.class AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach AS (
  SELECT class AS a, class AS b FROM classes
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_id AS (SELECT class, min(doc_id) AS id FROM named WHERE n > 0 GROUP BY class),
components AS (SELECT r.a AS class, min(i.id) AS id FROM reach r JOIN least_id i ON i.class = r.b GROUP BY r.a)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE c.id END AS component_id
FROM named LEFT JOIN components c USING (class)
"""
