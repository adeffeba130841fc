"""Operator 1: language identification with error-correcting output codes.

Each language has a codeword of +1 and -1. For every bit a binary linear
classifier over hashed letter n-grams predicts its sign; a text's outputs are
compared with each codeword by the sum of logistic losses, and the nearest
codeword wins (ties: the first language by name). Up to seven languages get
the exhaustive code, more a random dense code chosen for the distance of its
rows, so that single wrong bits are outvoted. A decision is *ambiguous* when
the runner-up's loss is within ``MARGIN`` of the winner's.

Features: the lower-cased text with everything but letters as one space,
trigrams of its UTF-8 bytes hashed to ``BUCKETS``, square roots of their
shares. Runs of spaces count as one feature that is dropped.

The classifiers are fitted on a bounded sample: about ``SAMPLE`` documents (``LEAST`` a language),
an equal bound for every language, chosen by a hash of the id from rows that
aren't held out and have a language. Only n-gram counts of that sample reach
the driver. Prediction reads whole texts and nothing but texts.

Defined results: null text, or text without a letter: ``und``, score 0,
ambiguous. No labelled row: everything is ``und``. One language: it is
predicted with score 1. Null ids are never learnt from and not held out.
Repeated rows get equal results and are learnt from once. Very long texts are
counted as a whole in their task. An empty table gives no row. Columns of other
names pass through ``with_language`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_limits, documents, fold, held_out

BUCKETS = 4096
SAMPLE = 2400       # labelled documents fitted on, over all languages, but
LEAST = 25          # at least so many of each language
LANGUAGES = 1024    # more are refused: what is fitted on has to fit the driver
MARGIN = 0.1        # loss difference below which a decision is ambiguous
ROUNDS = 120
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_SPACED = np.arange(256, dtype=np.uint32)
_SPACED[[i for i in range(128) if not chr(i).isalpha()]] = 0x20


def features(text: str | None) -> np.ndarray | None:
    """Unit-length vector of hashed trigrams; None if there is no letter."""
    if not text or not _LETTER.search(text):
        return None
    b = _SPACED[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    gram = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    gram = gram[gram != 0x202020]
    bucket = (gram * np.uint32(2654435761)) >> np.uint32(32 - 12)
    count = np.bincount(bucket, minlength=BUCKETS)
    return np.sqrt(count / max(1, len(bucket))).astype(np.float32)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """``k`` codewords as rows of +1 and -1."""
    if k < 2:
        return np.ones((k, 0))
    if k <= 7:  # every split of the languages into two non-empty sets
        columns = [c for c in product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns, float).T
    bits = int(np.ceil(10 * np.log2(k)))
    rng = np.random.Generator(np.random.PCG64(seed))
    best, most = None, -1
    for _ in range(100):
        code = rng.choice((-1.0, 1.0), (k, bits))
        distance = (bits - code @ code.T) / 2 + np.eye(k) * bits
        if distance.min() > most and (np.abs(code.sum(0)) < k).all():
            best, most = code, distance.min()
    return best


def fit(x: np.ndarray, label: np.ndarray, names: list[str]) -> dict:
    """One logistic classifier per bit, by accelerated gradient steps with
    every language weighing the same."""
    code = codewords(len(names))
    sign = code[label]
    weight = (1 / np.bincount(label, minlength=len(names)))[label][:, None] / len(names)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = step = np.zeros((x.shape[1], code.shape[1]), np.float32)
    for t in range(ROUNDS):
        ahead = w + (t / (t + 3)) * step
        slope = -sign * weight / (1 + np.exp(sign * (x @ ahead)))
        new = ahead - 4.0 * (x.T @ slope.astype(np.float32) + 1e-5 * ahead)
        w, step = new, new - w
    return {"names": names, "code": code, "weights": w}


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", sample: int = SAMPLE) -> dict:
    """Fit on the bounded sample of the rows that aren't held out."""
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang")) \
               .filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2))
    sizes = rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values; all of them would have to be learnt")
    names = sorted(r["lang"] for r in sizes)
    if not names:
        return {"names": [], "code": codewords(0), "weights": None}
    share = {r["lang"]: max(LEAST, sample / len(names)) / r["count"] for r in sizes}
    # repeated rows are drawn together, and count once
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", "text"), F.lit(1 << 20)) / (1 << 20)
    keep = F.create_map(*[F.lit(v) for p in share.items() for v in p])
    chosen = rows.filter(draw < keep[F.col("lang")]).select("lang", "text")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(lang, v) for lang, text in zip(*(c.to_pylist() for c in b.columns))
                     if (v := features(text)) is not None]
            used = [np.flatnonzero(v) for _, v in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang for lang, _ in found], pa.string()),
                 pa.array([u.astype("<u2").tobytes() for u in used], pa.binary()),
                 pa.array([v[u].astype("<f4").tobytes() for (_, v), u in zip(found, used)],
                          pa.binary())], names=["lang", "bucket", "value"])

    got = chosen.mapInArrow(counts, "lang string, bucket binary, value binary").distinct().collect()
    got.sort(key=lambda r: (r["lang"], r["bucket"], r["value"]))
    names = sorted({r["lang"] for r in got})
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["bucket"], "<u2")] = np.frombuffer(r["value"], "<f4")
    label = np.array([names.index(r["lang"]) for r in got], int)
    return fit(x, label, names) if names else {"names": [], "code": codewords(0), "weights": None}


def decode(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, loss margin) for rows of features."""
    code, w = model["code"], model["weights"]
    out = x @ w[:-1] + w[-1]
    loss = np.logaddexp(0, -out[:, None, :] * code[None]).sum(2)
    best = loss.argmin(1)
    share = np.exp(loss.min(1)[:, None] - loss)
    runner = np.partition(loss, 1, 1)[:, 1] if loss.shape[1] > 1 else loss[:, 0] + np.inf
    return best, 1 / share.sum(1), runner - loss.min(1)


def with_language(docs: DataFrame, model: dict, text_col: str = "text",
                  margin: float = MARGIN) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` and ``ambiguous``."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        names = model["names"]
        for b in batches:
            rows = [(UNDETERMINED, 0.0, True)] * len(b)
            if names:
                found = [(i, v) for i, t in enumerate(b.to_pylist()) if (v := features(t)) is not None]
                for at in range(0, len(found), 256):
                    part = found[at:at + 256]
                    best, score, gap = decode(np.array([v for _, v in part]), model)
                    for (i, _), k, s, g in zip(part, best, score, gap):
                        rows[i] = (names[k], float(s), bool(g < margin))
            yield pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), kind)] if rows
                else [pa.array([], f.type) for f in kind], fields=list(kind))

    added = ("lang_pred", "score", "ambiguous")
    kept = [F.col(c) for c in docs.columns if c not in added]
    return docs.withColumn("_said", identify(F.col(text_col).cast("string"))) \
               .select(*kept, *[F.col(f"_said.{c}").alias(c) for c in added])


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    said = with_language(docs.select("doc_id", "text"), learn(docs))
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                       "ambiguous")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a language, decided without ambiguity."""
    said = with_language(docs.withColumnsRenamed({c: f"_own_{c}" for c in ("lang_pred", "score", "ambiguous")
                                                  if c in docs.columns}), learn(docs))
    kept = said.filter((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous"))
    return kept.select(*[F.col(f"_own_{c}").alias(c) if f"_own_{c}" in kept.columns else F.col(c)
                         for c in docs.columns])
