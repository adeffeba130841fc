"""Operator 5: quality score from histogram gradient-boosted trees.

``statistics`` turns a whole text into a short vector of numbers (lengths,
shares of character classes, repetition of words and lines). The trees are
fitted on a bounded sample of labelled rows: about ``SAMPLE`` rows that aren't
held out, chosen by a hash of the id. Only the statistics of that sample reach
the driver, where each is cut into at most ``BINS`` bins by quantiles; every
level of a tree takes the split of largest gain from histograms of gradients
and curvatures of the logistic loss.

A fitted model is three arrays over (tree, node): feature, threshold and value
of complete trees of equal depth, nodes numbered as in a heap. Scoring walks
all documents of a batch through all trees at once, one level per step.

Defined results: null and empty texts have all-zero statistics and get the
score the trees give for that; labels of a repeated id are averaged and
rounded up at one half; null labels and ids are never learnt from; without any
label, every score is 0.5; repeated rows get equal scores; very long texts are
measured as a whole in their task; an empty table gives no row; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_limits, documents, fold, held_out, stage

SAMPLE = 12_000     # labelled rows fitted on
BINS = 48
TREES = 80
DEPTH = 4
RATE = 0.15
THRESHOLD = 0.7

# classes of UTF-8 bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank,
# 5 line end, 6 sentence mark, 7 further ASCII symbol, 8 above ASCII
_CLASS = np.zeros(256, np.uint8)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = (8 if _i > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit()
                  else 5 if _c == "\n" else 4 if _c.isspace() else 6 if _c in ".,;:?!'\"-()"
                  else 7 if _c.isprintable() else 0)


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text."""
    if not text:
        return [0.0] * N_STATISTICS
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kind = _CLASS[data]
    share = np.bincount(kind, minlength=9) / len(data)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    counted = Counter(words)
    common = [c for _, c in counted.most_common(3)] + [0, 0, 0]
    length = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    line_count = Counter(lines)
    byte_share = np.bincount(data, minlength=256) / len(data)
    present = byte_share[byte_share > 0]
    ends = sum(x.rstrip()[-1] in ".!?" for x in lines)
    symbols = int(np.count_nonzero((kind[1:] == 7) & (data[1:] == data[:-1])))
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(np.log1p(len(lines))),
        float(length.mean()) if len(words) else 0.0, float(length.std()) if len(words) else 0.0,
        float(length.max()) if len(words) else 0.0,
        *map(float, share[1:9]),
        len(counted) / n, pairs, common[0] / n, sum(common[:3]) / n,
        len(line_count) / m, max(line_count.values(), default=0) / m, n / m, ends / m,
        float(-(present * np.log(present)).sum()), symbols / len(data),
        sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
    ]


N_STATISTICS = 6 + 8 + 8 + 4


def _best_split(g: np.ndarray, h: np.ndarray, least: float = 2.0, ridge: float = 1.0):
    """(feature, last bin that goes left) of largest gain from histograms of
    shape (features, bins); None if no split gains."""
    gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    gr, hr = gt - gl, ht - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gt**2 / (ht + ridge)
    gain[(hl < least) | (hr < least)] = 0
    at = int(gain.argmax())
    return divmod(at, gain.shape[1]) if gain.flat[at] > 1e-6 else None


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH,
        bins: int = BINS, rate: float = RATE) -> dict:
    """Boosted trees for labels 0 and 1 as flat arrays."""
    inner, nodes = 2**depth - 1, 2**(depth + 1) - 1
    feature = np.zeros((trees, nodes), np.int32)
    threshold = np.full((trees, nodes), np.inf)
    value = np.zeros((trees, nodes))
    if not len(y):
        return {"base": 0.0, "depth": depth, "feature": feature, "threshold": threshold, "value": value}
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1)
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), base)
    columns = np.arange(x.shape[1])
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            slot = ((node - first)[:, None] * len(columns) + columns) * bins + binned
            size = 2**level * len(columns) * bins
            shape = (2**level, len(columns), bins)
            gs = np.bincount(slot.ravel(), np.repeat(g, len(columns)), size).reshape(shape)
            hs = np.bincount(slot.ravel(), np.repeat(h, len(columns)), size).reshape(shape)
            for k in range(2**level):
                if found := _best_split(gs[k], hs[k]):
                    f, b = found
                    feature[t, first + k] = f
                    threshold[t, first + k] = cuts[f][b] if b < len(cuts[f]) else np.inf
            # a node without a split sends everything left
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        step = np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1.0)
        value[t, inner:] = rate * step
        score += value[t, node]
    return {"base": base, "depth": depth, "feature": feature, "threshold": threshold, "value": value}


def predict(x: np.ndarray, model: dict) -> np.ndarray:
    """Probability of label 1 for rows of statistics."""
    tree = np.arange(len(model["feature"]))[None, :]
    row = np.arange(len(x))[:, None]
    node = np.zeros((len(x), tree.size), np.int64)
    for _ in range(model["depth"]):
        right = x[row, model["feature"][tree, node]] > model["threshold"][tree, node]
        node = 2 * node + 1 + right
    return 1 / (1 + np.exp(-(model["base"] + model["value"][tree, node].sum(1))))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """Fit on the bounded sample of labelled rows that aren't held out."""
    arrow_limits(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("mark")) \
                  .filter(F.col("mark").isNotNull() & (fold(F.col("doc_id")) != 2)) \
                  .groupBy("doc_id").agg((F.avg("mark") >= 0.5).cast("double").alias("mark"))
    total = marks.count()
    draw = F.pmod(F.xxhash64(F.lit("quality sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    # staged: about `sample` rows of 16 bytes, broadcast below
    chosen = stage(marks.filter(draw < sample / max(1, total)), "quality-sample")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
               .join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("mark"), pa.array(found, pa.list_(pa.float64()))],
                names=["doc_id", "mark", "x"])

    got = rows.mapInArrow(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()},"
                                   " mark double, x array<double>").collect()
    got.sort(key=lambda r: (str(r["doc_id"]), r["x"]))
    return fit(np.array([r["x"] for r in got]).reshape(len(got), N_STATISTICS),
               np.array([r["mark"] for r in got], float))


def with_quality(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score``."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            x = np.array([statistics(t) for t in b.to_pylist()]).reshape(len(b), N_STATISTICS)
            yield pa.array(predict(x, shared.value), pa.float64())

    return docs.withColumn("score", rate(F.col(text_col).cast("string")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = with_quality(docs.select("doc_id", "text"), learn(docs, labels))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
