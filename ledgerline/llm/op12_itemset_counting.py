"""Operator 12: phrases of up to four words by dynamic itemset counting.

Documents are dealt into ``SHARDS`` shards, scanned in turn and again from the first.
Phrases of all lengths are counted in the same scans. Words count from the start;
a longer phrase becomes active at the step after both its subphrases (all words but the last, all
but the first) have reached ``least`` by running counts, and is counted in the ``SHARDS``
scans from there on: one full cycle, so its count is exact. The scans end
when no phrase is active. A phrase with ``least`` occurrences has subphrases
with as many, so each is activated, at the latest by the step after their cycles.

A word is the 64-bit hash of its language and bytes, a phrase the row of its words' hashes,
``w1`` to ``w4`` (0: none). Words come with their text; should two have one
hash, which is tested over all words, everything is counted again with other hashes.
A scan counts runs of words task by task in numpy. Which phrases are active it knows
from a table of steps per length: at each of two places found from its hashes, the first step in which a
phrase of that place reached ``least``; the later of the two counts. Phrases may share places, and a phrase whose places
are both taken becomes active earlier than it had to, but never before its subphrases. It is still counted in one full cycle,
beginning where the table says, for entries never change: clashes cost time, not exactness, and the tables' sizes,
which follow the input up to ``PLACES``, don't matter to the result. An entry takes four bits, and a worker has each
table once: the tables are broadcast by themselves, not as a part of the pickled function, which a worker keeps
beside what it makes of it.
A step's counts are added to those of the active phrases by one aggregation, which begins before
the shuffle, and staged.

Scores, cuts and containment are joins on the counted phrases, in decimals.

Defined results: null and empty texts have no words; a null language is ``und``; null and
repeated ids make no difference (ids are not read), each row is a document; very long texts are
read in slices that end at a piece's end; ties are cut as stated (smallest first
part, then phrase in byte order); an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_limits, documents, stage
from ledgerline.llm.words import mix, span_hashes
from ledgerline.operators.sequence import discard, scanned_bytes, staging_folder

LEAST = 30
TOP = 2000
LONGEST = 4
SHARDS = 3
SLICE = 1 << 18            # bytes parsed at a time
GROUP_WORDS = 1 << 20      # words counted at a time
BATCH = 1 << 16            # counts sent to the JVM at a time
PLACES = 1 << 27           # of the pairs' table; triples have half as many
WORD_PLACES = 1 << 24      # words grow more slowly than the input
UNSEEN = 255               # steps are fewer: LONGEST times SHARDS
WORDS = ["w1", "w2", "w3", "w4"]
NEVER = 1 << 30
ROW = "w1 long, w2 long, w3 long, w4 long, lang string, word string, n long, act int"
_U = np.uint64
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")
_KIND = np.zeros(256, np.uint8)  # 0 word, 1 blank, 2 end of a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class HashClash(Exception):
    """Two words have one hash."""


def slices(text: bytes) -> Iterator[bytes]:
    """The text in parts that end where a piece ends."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


class Run:
    """Words of some documents: hashes, whether the next word is in the same
    piece, and where the words stand."""

    def __init__(self, seed: int):
        self.byte = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=_U)
        self.langs: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.waiting: list[tuple[int, bytes]] = []
        self.size = self.n = self.base = 0
        self.parts: list[tuple] = []

    def add(self, lang: str, text: bytes) -> bool:
        """Whether there are enough words to count."""
        code = self.langs.setdefault(lang, len(self.langs))
        for part in slices(text):
            self.waiting.append((code, part))
            self.size += len(part) + 1
            if self.size >= SLICE:
                self._parse()
        return self.n >= GROUP_WORDS

    def _parse(self) -> None:
        data = _LOWER[np.frombuffer(b"\n".join([t for _, t in self.waiting] + [b""]), np.uint8)]
        kind = _KIND[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], kind > 0)).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        if len(start):
            lengths = np.fromiter((len(t) + 1 for _, t in self.waiting), np.int64, len(self.waiting))
            codes = np.fromiter((c for c, _ in self.waiting), np.int64, len(self.waiting))
            lang = codes[np.searchsorted(np.cumsum(lengths), start, side="right")]
            salt = mix(self.byte[0] ^ np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest())
                                                for x in self.langs], _U))
            h = mix(span_hashes(self.byte[data], start, end) ^ salt[lang])
            h[h == 0] = 1  # 0 is no word
            piece = np.cumsum(kind == 2, dtype=np.int64)[start]
            together = np.append(piece[1:] == piece[:-1], False)
            place = [(x + self.base).astype(np.int32 if self.base + len(data) < 1 << 31 else np.int64) for x in (start, end)]
            self.parts.append((h, together, lang.astype(np.int32), *place, data))
            self.n += len(start)
            self.base += len(data)
        self.waiting, self.size = [], 0

    def arrays(self) -> tuple:
        if self.waiting:
            self._parse()
        if not self.parts:
            return ()
        columns, self.parts = list(zip(*self.parts)), []
        out = []
        while columns:  # one after the other: what has been joined goes
            out.append(np.concatenate(columns.pop(0)))
        return tuple(out)


def table_places(scanned: int, places: int | None = None) -> list[int]:
    """Places of the tables of words, pairs and triples for ``scanned`` bytes of
    input; ``places``: those of the pairs."""
    pairs = places or min(PLACES, max(1 << 16, 1 << (scanned // 128).bit_length()))
    return [min(pairs, WORD_PLACES), pairs, max(1, pairs // 2)]


class Steps:
    """By place, the first step in which one was entered there: in four bits (all set:
    none), or in eight where there are more than 15 steps."""

    def __init__(self, places: int, steps: int, cells: np.ndarray | None = None):
        self.places, self.half = places, steps <= 15
        self.unseen = 15 if self.half else UNSEEN  # later than all steps
        self.cells = np.full(-(-places // 2) if self.half else places, UNSEEN, np.uint8) if cells is None else cells

    def at(self, slot: np.ndarray) -> np.ndarray:
        if not self.half:
            return self.cells[slot]
        return (self.cells[slot >> _U(1)] >> ((slot & _U(1)) << _U(2)).astype(np.uint8)) & np.uint8(15)

    def enter(self, begin: int, hit: np.ndarray, step: int) -> None:
        """``step`` for the places from ``begin`` on, an even number, that ``hit`` tells, if they have none."""
        hit = hit[:self.places - begin]
        if not self.half:
            part = self.cells[begin:begin + len(hit)]
            part[hit & (part == UNSEEN)] = step
            return
        hit = np.append(hit, np.zeros(len(hit) % 2, bool))
        part = self.cells[begin // 2:(begin + len(hit)) // 2]
        for own, shift in ((hit[0::2], 0), (hit[1::2], 4)):
            free = own & ((part >> shift) & 15 == 15)
            part[free] ^= np.uint8((15 ^ step) << shift)

    def reached(self, rows: list[np.ndarray]) -> np.ndarray:
        """The step of each phrase: the later one of its two places."""
        out = self.at(slots(rows, self.places))
        at = np.flatnonzero(out != self.unseen)
        out[at] = np.maximum(out[at], self.at(slots([turned(r[at]) for r in rows], self.places)))
        return out


def turned(h: np.ndarray) -> np.ndarray:
    """The hashes with their halves exchanged, for the second place: ``slots`` then reads other bits."""
    return (h << _U(32)) | (h >> _U(32))


def turned_column(w: str) -> Column:
    return F.shiftleft(w, 32).bitwiseOR(F.shiftrightunsigned(w, 32))


def slots(rows: list[np.ndarray], places: int) -> np.ndarray:
    """A phrase's place in the table of its length."""
    out = rows[0].copy()
    for i, r in enumerate(rows[1:], 1):
        out ^= r >> _U(20 * i)
    return out & _U(places - 1)


def slot_column(places: int) -> Column:
    out = F.col("w1")
    for i, w in enumerate(WORDS[1:3], 1):
        out = out.bitwiseXOR(F.shiftrightunsigned(w, 20 * i))
    return out.bitwiseAND(F.lit(places - 1))


def _tally(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of a first row, number) of each run of equal rows, brought together
    by a hash of them; rows whose hashes clash stay apart."""
    key = rows[0].copy()
    for r in rows[1:]:
        key = mix(key) + r
    order = np.argsort(key)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for r in rows:
        r = r[order]
        new[1:] |= r[1:] != r[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def counted(run: Run, step: int, shards: int, tables: list) -> Iterator[pa.RecordBatch]:
    """Counts of the run's words, in the first cycle, and of its phrases that are
    active in ``step``. ``tables``: by length, the steps in which places were reached."""
    arrays = run.arrays()
    if not arrays:
        return
    h, together, lang, start, end, data = arrays
    del arrays
    if step < shards:
        first, n = _tally([h])
        raw, names = data.tobytes(), list(run.langs)
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first].tolist(), end[first].tolist())]
        yield from _batches([h[first]], n, np.zeros(len(n), np.int32), [names[c] for c in lang[first].tolist()], texts)
        del first, n, raw, texts
    del lang, start, end, data
    since = None  # step in which the phrase of k - 1 words from a place on was reached
    for k in range(2, LONGEST + 1):
        if tables[k - 2] is None or len(h) < k:
            return
        shorter = [h[i:len(h) - k + 2 + i] for i in range(k - 1)]  # all runs of k - 1 words
        reached = tables[k - 2].reached(shorter)
        if k > 2:  # not before its own subphrases, whatever shares its place
            reached = np.maximum(reached, np.maximum(since[:-1], since[1:]))
            reached[~together[k - 3:len(h) - 1]] = UNSEEN
        since = reached
        latest = np.maximum(since[:-1], since[1:])
        use = (latest < step) & (latest.astype(np.int16) >= step - shards) & together[k - 2:len(h) - 1]
        if k > 2:
            use &= together[:len(use)]
        at = np.flatnonzero(use)
        if len(at):
            rows = [h[at + i] for i in range(k)]
            first, n = _tally(rows)
            yield from _batches([r[first] for r in rows], n, latest[at[first]].astype(np.int32) + 1)


def _batches(rows: list[np.ndarray], n: np.ndarray, act: np.ndarray, langs: list | None = None,
             texts: list | None = None) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(n), BATCH):
        part = slice(i, i + BATCH)
        yield _batch([r[part] for r in rows], n[part], act[part], langs and langs[part], texts and texts[part])


def _batch(rows: list[np.ndarray], n: np.ndarray, act: np.ndarray, langs: list | None = None,
           texts: list | None = None) -> pa.RecordBatch:
    none = np.zeros(len(n), np.int64)
    rows = [r.view(np.int64) for r in rows] + [none] * (LONGEST - len(rows))
    text = lambda v: pa.array(v, pa.string()) if v is not None else pa.nulls(len(n), pa.string())
    return pa.record_batch([*map(pa.array, rows), text(langs), text(texts), pa.array(n, pa.int64()), pa.array(act)],
                           names=[*WORDS, "lang", "word", "n", "act"])


class Counter:
    """The cyclic scans over the staged shards."""

    def __init__(self, docs: DataFrame, lang_col: str, text_col: str, least: int, shards: int, seed: int,
                 places: int | None = None):
        self.spark, self.least, self.shards, self.seed = docs.sparkSession, least, shards, seed
        if LONGEST * shards >= UNSEEN:
            raise ValueError("too many shards")
        arrow_limits(self.spark)
        self.places = table_places(scanned_bytes(docs), places)
        self.path = f"{staging_folder(self.spark)}/llm-phrase-shards-{uuid.uuid4().hex}"
        # dealt by place, so that copies don't meet in one shard
        docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                    F.col(text_col).cast("string").cast("binary").alias("text"),
                    F.pmod(F.monotonically_increasing_id(), F.lit(shards)).alias("shard")) \
            .write.partitionBy("shard").parquet(self.path)
        self.shard_rows = self.spark.read.schema("lang string, text binary, shard int").parquet(self.path)
        self.tables: list[Steps | None] = [None] * (LONGEST - 1)
        self.sent: list[Broadcast | None] = [None] * (LONGEST - 1)
        self.found: list[DataFrame] = []
        self.totals: DataFrame | None = None

    def _scan(self, t: int) -> DataFrame:
        shards, seed, sent = self.shards, self.seed, list(zip(self.places, self.sent))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run, tables = Run(seed), [b and Steps(p, LONGEST * shards, b.value) for p, b in sent]
            for b in batches:
                for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                    if run.add(lang, text.as_py() or b""):
                        yield from counted(run, t, shards, tables)
                        run.clear()
            yield from counted(run, t, shards, tables)

        rows = self.shard_rows.filter(F.col("shard") == t % shards).select("lang", "text")
        return rows.mapInArrow(scan, ROW)

    def _learn(self, state: DataFrame, t: int) -> bool:
        """Enter the phrases reached in step ``t``; whether there are any. What
        comes to the driver is bounded by the size of the tables."""
        new = state.filter((F.col("reached") == t) & (F.col("w4") == 0))
        length = F.when(F.col("w2") == 0, 0).when(F.col("w3") == 0, 1).otherwise(2).alias("k")
        # each with its two places
        both = new.select(F.inline(F.array(*[F.struct(length, *[f(w).alias(w) for w in WORDS[:3]])
                                             for f in (F.col, turned_column)])))
        words, pairs, triples = [slot_column(p) for p in self.places]
        slot = F.when(F.col("k") == 0, words).when(F.col("k") == 1, pairs).otherwise(triples) + 1  # Spark counts these from 1
        # places are brought together, not bitmaps, of which each task would send one for nearly every place
        got = both.select("k", slot.alias("slot")).select("k", F.bitmap_bucket_number("slot").alias("at"), F.bitmap_bit_position("slot").alias("bit")) \
                  .repartition("k", "at").groupBy("k", "at").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
        for r in got:
            if self.tables[r.k] is None:
                self.tables[r.k] = Steps(self.places[r.k], LONGEST * self.shards)
            hit = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little") > 0
            self.tables[r.k].enter((r["at"] - 1) * len(hit), hit, t)
        for k in {r.k for r in got}:
            self._unsend(k)
            self.sent[k] = self.spark.sparkContext.broadcast(self.tables[k].cells)
        return bool(got)

    def _unsend(self, k: int) -> None:
        """The broadcast table goes; what was made with it has been staged."""
        if self.sent[k] is not None:
            self.sent[k].destroy()
            self.sent[k] = None

    def run(self) -> Counter:
        try:
            return self._run()
        finally:
            for k in range(len(self.sent)):
                self._unsend(k)

    def _run(self) -> Counter:
        state, t, latest = None, 0, 0
        # a phrase reached in step s activates others for the steps up to s + shards
        while t < self.shards or t <= latest + self.shards:
            rows = self._scan(t).withColumn("reached", F.lit(NEVER))
            if state is not None:
                rows = rows.unionByName(state.filter(F.col("act") > t - self.shards))
            sums = rows.groupBy(*WORDS, "lang", "word").agg(
                F.sum("n").alias("n"), F.min("act").alias("act"), F.min("reached").alias("reached"))
            sums = sums.withColumn("reached", F.when((F.col("n") >= self.least) & (F.col("reached") == NEVER), t)
                                   .otherwise(F.col("reached")).cast("int"))
            state, old = stage(sums, "phrase-counts"), state
            if old is not None:
                discard(old)
            if self._learn(state, t):
                latest = t
            if t >= self.shards - 1:
                done = state.filter((F.col("act") == t - self.shards + 1) & (F.col("n") >= self.least))
                self.found.append(stage(done.drop("act", "reached"), "phrase-found"))
            if t == self.shards - 1:
                words = state.filter(F.col("w2") == 0)
                if words.groupBy("w1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
                    raise HashClash
                self.totals = stage(words.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
            t += 1
        discard(state)
        return self


def frequent(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
             shards: int = SHARDS, places: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``w1`` to ``w4``, ``lang``, ``word``, ``n``) of all phrases with ``least``
    occurrences in their language (texts on single words), and (lang, total)."""
    spark = docs.sparkSession
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # each step's shuffle files go with the step
    try:
        for seed in range(1, 99):
            try:
                c = Counter(docs, lang_col, text_col, least, shards, seed, places).run()
                break
            except HashClash:
                continue
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    out = c.found[0]
    for f in c.found[1:]:
        out = out.unionByName(f)
    return stage(out, "phrase-all"), c.totals


def _key(words: Column) -> list[Column]:
    return [F.coalesce(F.get(words, F.lit(i)), F.lit(0)).alias(f"key{i}") for i in range(3)]


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP,
            shards: int = SHARDS, places: int | None = None) -> DataFrame:
    """The first ``top`` phrases of each language. ``places``: size of the pairs' table
    of steps, a power of two."""
    found, totals = frequent(docs, lang_col, text_col, least, shards, places)
    wide = lambda c: c.cast("decimal(28,0)")
    words = F.filter(F.array(*WORDS), lambda w: w != 0)
    counts = found.filter("w4 = 0").select(*[F.col(w).alias(f"key{i}") for i, w in enumerate(WORDS[:3])], F.col("n").alias("count"))
    longer = found.filter("w2 <> 0").select(*WORDS, F.col("n").alias("a"), words.alias("ws")).withColumn("size", F.size("ws"))
    keys = ["key0", "key1", "key2"]
    cuts = longer.select(*WORDS, "a", "size", "ws", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    first = cuts.select(*WORDS, "cut", *_key(F.slice("ws", F.lit(1), F.col("cut")))) \
                .join(counts, keys).select(*WORDS, "cut", F.col("count").alias("l"))
    rest = cuts.select(*WORDS, "cut", "a", *_key(F.slice("ws", F.col("cut") + 1, F.col("size")))) \
               .join(counts, keys).select(*WORDS, "cut", "a", F.col("count").alias("r"))
    score = F.call_function("div", F.lit(2000000).cast("decimal(8,0)") * wide(F.col("a")), wide(F.col("l")) + wide(F.col("r")))
    best = first.join(rest, [*WORDS, "cut"]).groupBy(*WORDS, "a").agg(
        F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    inside = longer.filter("size > 2").select("a", "size", "ws", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("width")) \
        .select("a", "width", "ws", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("width") + 1)).alias("from")) \
        .select("a", *_key(F.slice("ws", F.col("from"), F.col("width")))).groupBy(*keys).agg(F.max("a").alias("above"))
    best = best.select("*", *[F.when(F.col("w4") == 0, F.col(w)).otherwise(0).alias(f"key{i}") for i, w in enumerate(WORDS[:3])]) \
               .join(inside, keys, "left") \
               .filter((F.col("w4") != 0) | F.col("above").isNull() | (wide(F.col("above")) * 100 < wide(F.col("a")) * 80))
    texts = found.filter("w2 = 0").select(F.col("w1").alias("id"), "lang", "word")
    best = best.select(*WORDS, "a", "best.*")
    for i, w in enumerate(WORDS):
        side = texts.select(F.col("id").alias(w), F.col("word").alias(f"t{i}"), *(["lang"] if i == 0 else []))
        if i < 2:
            best = best.join(side, w)
        else:
            # without that word, a key of their own, so that they don't meet in one task
            best = best.withColumn(w, F.when(F.col(w) == 0, None).otherwise(F.col(w))).join(side, w, "left")
    best = best.withColumn("phrase", F.concat_ws(" ", "t0", "t1", "t2", "t3")).join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_itemset_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(documents(spark, sf_dir))


SQL = f"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cand AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS cut FROM cand),
scored AS (
  SELECT x.lang, x.k, x.phrase, x.a, cut, p.c AS l, q.c AS r,
         ((2000000::HUGEINT * x.a) // (p.c + q.c))::BIGINT AS score
  FROM cuts x JOIN f p ON p.lang = x.lang AND p.phrase = array_to_string(x.ws[1:cut], ' ')
              JOIN f q ON q.lang = x.lang AND q.phrase = array_to_string(x.ws[cut + 1:x.k], ' ')
  QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, cut) = 1),
inner_widths AS (SELECT lang, a, ws, k, unnest(range(2, k)) AS width FROM cand WHERE k > 2),
inner_phrases AS (
  SELECT lang, a, unnest(list_transform(range(1, k - width + 2), lambda i: array_to_string(ws[i:i + width - 1], ' '))) AS phrase
  FROM inner_widths),
above AS (SELECT lang, phrase, max(a) AS above FROM inner_phrases GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM scored LEFT JOIN above USING (lang, phrase) JOIN totals USING (lang)
WHERE above IS NULL OR 100 * above < 80 * a
QUALIFY rank <= {TOP}
"""
