"""Operator 11: hard negatives by inner product, from cover trees.

Candidates get one component more, ``sqrt(M^2 - |x|^2)`` with ``M`` the largest
norm, so that all lie on a sphere; with a zero there, a query's inner products
stay as they are. On the sphere they are angles: if ``c`` is a node's point and
``t`` the angle of its covering radius, the inner products of all below the node
lie between ``|q| M cos(a + t)`` and ``|q| M cos(a - t)``, ``a`` the angle of query
and ``c``. A search goes down from the node with the highest bound, skips nodes
outside all windows of the query or below what it has found, and compares
points by exact integer products.

The upper level of the tree is a bounded number of pivots, chosen from a sample of
``SAMPLE`` rows (choice of pivots only: every row is indexed and results are exact). A
row goes to its nearest pivot; the rows of a pivot and label are cut by a hash into
units of about ``UNIT_ROWS``, each of which gets a cover tree of its own: node
``c`` at level ``i`` covers what lies within ``2^i``; points that aren't within
``2^(i-1)`` of one of its children become children. Small labels share units. The
trees are staged, a row each. Queries are gathered in blocks by pivot; a block is
searched in the units of the pivots whose bounds meet one of its windows, and
what it has found in one unit narrows the next. No task holds more than a unit
and a block, whatever label, pivot or vector has a third of all rows.

Two searches are made: the best of the same label for each anchor, then, for each
anchor and positive, the best of other labels within the window.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component, take no part; exact repetitions of a row (id, label and vector) count once; a
shorter vector is filled with zeros; ties go to the smaller id, then (an id under several
vectors) to either; anchors without positives, and positives without negatives, give no row; an empty
table gives no row; other columns are ignored. Scores must fit 64 bits, else the job
fails; those beyond 2^53 are computed with unbounded integers.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_limits, stage

UNIT_ROWS = 2048
BLOCK_ROWS = 512
BUCKET = 16                # so few points hang below a node without further levels
SAMPLE = 2048
MAX_PIVOTS = 256
UNITS_PER_PIVOT = 64
EXACT = 1 << 53            # integers up to here are exact as doubles
TOP = (1 << 63) - 1


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def _angles(squares: np.ndarray, m2: float) -> np.ndarray:
    """Angle of two points of the sphere from their squared distance."""
    return np.arccos(np.clip(1 - squares / (2 * m2 or 1), -1, 1))


def squared_distances(a: np.ndarray, b: np.ndarray, m2: float) -> np.ndarray:
    """Between norm-augmented rows of ``a`` and ``b``."""
    up = lambda x: np.sqrt(np.maximum(0, m2 - np.einsum("ij,ij->i", x, x)))
    # all norms are M, so that |a - b|^2 = 2 M^2 - 2 ab
    return np.maximum(0, 2 * m2 - 2 * (a @ b.T + np.outer(up(a), up(b))))


class CoverTree:
    """Nodes in breadth-first order: ``point``, ``angle`` (of the covering radius)
    and the range ``first`` to ``last`` of the children (empty: a point)."""

    def __init__(self, points: np.ndarray, m2: float, nodes: dict[str, np.ndarray] | None = None):
        self.points, self.m2 = points, m2
        self.nodes = nodes or self._build(points.astype(np.float64))

    def _build(self, x: np.ndarray) -> dict[str, np.ndarray]:
        d = np.sqrt(squared_distances(x, x, self.m2))
        point, radius, first, last = [0], [d[0].max()], [], []
        below = [np.arange(len(x))]
        at = 0
        while at < len(point):
            rows, r = below[at], radius[at]
            first.append(len(point))
            if len(rows) > 1:
                if r == 0 or len(rows) <= BUCKET:
                    groups = [(p, rows[i:i + 1]) for i, p in enumerate(rows)]
                else:
                    groups = self._children(d, point[at], rows, 2.0 ** (np.ceil(np.log2(r)) - 1))
                for c, part in groups:
                    point.append(c)
                    radius.append(d[c, part].max())
                    below.append(part)
            last.append(len(point))
            below[at] = None
            at += 1
        return {"point": np.array(point), "angle": _angles(np.square(radius), self.m2),
                "first": np.array(first), "last": np.array(last)}

    @staticmethod
    def _children(d: np.ndarray, c: int, rows: np.ndarray, reach: float) -> list[tuple[int, np.ndarray]]:
        """Centres further than ``reach`` apart, each with the rows nearest to it."""
        centres, near = [c], d[c, rows].copy()
        owner = np.zeros(len(rows), np.int64)
        while near.max() > reach:
            centres.append(rows[int(np.argmax(near > reach))])
            far = d[centres[-1], rows]
            closer = far < near
            near[closer] = far[closer]
            owner[closer] = len(centres) - 1
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        return [(p, rows[order[a:b]]) for p, a, b in zip(centres, cuts, cuts[1:])]

    def search(self, q: np.ndarray, found: Found, allowed: np.ndarray) -> int:
        """Offer ``found`` the allowed points that can be among its best;
        the number of products made."""
        n, made = self.nodes, 0
        if not hasattr(self, "centres"):
            exact = float(self.m2) * max(1.0, float(q @ q)) < float(EXACT) ** 2
            self.centres = self.points.astype(np.float64 if exact else object)[n["point"]]
        length = float(np.sqrt(float(q @ q)) * np.sqrt(self.m2))
        slack = 1e-7 * length + 1e-6
        heap = [(-np.inf, 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if not found.wants(-bound):
                break
            kids = slice(n["first"][node], n["last"][node]) if n["first"][node] < n["last"][node] else slice(0, 1)
            score = self.centres[kids] @ q
            made += len(score)
            leaf = n["first"][kids] == n["last"][kids]
            rows = n["point"][kids][leaf]
            ok = allowed[rows]
            found.offer(score[leaf][ok], rows[ok])
            inner = np.flatnonzero(~leaf)
            if len(inner) and length > 0:
                a = np.arccos(np.clip(score[inner].astype(np.float64) / length, -1, 1))
                t = n["angle"][kids][inner]
                high = length * np.cos(np.maximum(0, a - t)) + slack
                low = length * np.cos(np.minimum(np.pi, a + t)) - slack
                for i, h in zip(inner[use := found.meets(low, high)], high[use]):
                    heapq.heappush(heap, (-h, kids.start + int(i)))
            elif len(inner):
                for i in inner:
                    heapq.heappush(heap, (0.0, kids.start + int(i)))
        return made


class Found:
    """The best ``k`` (score, id) of each window of one query."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.least = low.copy()  # what a row must score to get into a window's list
        self.best = [(np.empty(0, object), np.empty(0, np.int64)) for _ in low]

    def wants(self, bound: float) -> bool:
        return bool((self.least <= bound).any())

    def meets(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return ((high[:, None] >= self.least) & (low[:, None] <= self.high)).any(axis=1)

    def offer(self, score: np.ndarray, rows: np.ndarray) -> None:
        if not len(score):
            return
        ids = self.ids[rows]
        for j in range(len(self.low)):
            use = (score >= self.least[j]) & (score <= self.high[j])
            if use.any():
                s = np.concatenate((self.best[j][0], score[use].astype(object)))
                i = np.concatenate((self.best[j][1], ids[use]))
                if abs(s).max() < EXACT:
                    order = np.lexsort((i, -s.astype(np.float64)))[:self.k]
                else:
                    order = np.array(sorted(range(len(s)), key=lambda n: (-s[n], i[n]))[:self.k])  # noqa: B023
                self.best[j] = s[order], i[order]
                if len(order) == self.k:
                    self.least[j] = max(self.low[j], int(s[order[-1]]))


def prepared(rows: DataFrame, id_col: str, label: Column, vector: Column) -> DataFrame:
    """(vec_id, label, x): rows that take part, with integer vectors."""
    v = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), v.alias("v"), bad.alias("bad")) \
               .filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND NOT bad") \
               .select("vec_id", "label", F.transform("v", lambda c: F.floor(c)).alias("x"))


class Index:
    """The staged units of all candidates, and what a search needs to know."""

    def __init__(self, vectors: DataFrame):
        self.spark = vectors.sparkSession
        arrow_limits(self.spark)
        rows = stage(vectors.dropDuplicates(), "negatives-rows")
        square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
        top = F.coalesce(F.array_max(F.transform("x", lambda c: F.abs(c))), F.lit(0))
        self.n, m2, size, most = rows.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("x")), F.max(top)).first()
        self.m2, self.size = float(m2 or 0) * (1 + 1e-12), size or 0
        self.kind = next(t for t in ("<i2", "<i4", "<i8") if (most or 0) <= np.iinfo(t).max)
        self.pivots = self._choose(rows)
        self.rows = stage(self._dealt(rows), "negatives-cells")
        self.radii = self._radii()
        self.units = self._trees()

    def _choose(self, rows: DataFrame) -> np.ndarray:
        """Pivots from the sample, each the furthest from those before."""
        wanted = max(1, min(MAX_PIVOTS, self.n // (UNIT_ROWS * UNITS_PER_PIVOT)))
        sample = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE if wanted > 1 else 1).select("x").collect()
        x = np.zeros((max(1, len(sample)), self.size))
        for i, r in enumerate(sample):
            x[i, :len(r.x)] = r.x
        chosen, near = [0], squared_distances(x, x[:1], self.m2)[:, 0]
        while len(chosen) < wanted and near.max() > 0:
            chosen.append(int(np.argmax(near)))
            near = np.minimum(near, squared_distances(x, x[chosen[-1:]], self.m2)[:, 0])
        return x[chosen]

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """The rows as (vec_id, label, x, cell, square): packed vectors, nearest
        pivot and the squared distance to it."""
        size, kind, pivots, m2 = self.size, self.kind, self.pivots, self.m2

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.zeros((b.num_rows, size), np.int64)
                for i, v in enumerate(b.column("x").to_pylist()):
                    x[i, :len(v)] = v
                far = squared_distances(x.astype(np.float64), pivots, m2)
                cell = far.argmin(axis=1)
                yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array([v.astype(kind).tobytes() for v in x], pa.binary()),
                                       pa.array(cell, pa.int64()), pa.array(far[np.arange(len(x)), cell])],
                                      names=["vec_id", "label", "x", "cell", "square"])

        kind_of = rows.schema["label"].dataType.simpleString()
        return rows.mapInArrow(deal, f"vec_id long, label {kind_of}, x binary, cell long, square double")

    def _radii(self) -> np.ndarray:
        """Angle that each pivot covers; one row per pivot comes back."""
        out = np.zeros(len(self.pivots))
        for r in self.rows.groupBy("cell").agg(F.max("square").alias("square")).collect():
            out[r.cell] = r.square
        return _angles(out, self.m2)

    def _trees(self) -> DataFrame:
        sizes = self.rows.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"))
        share = max(1, -(-self.n // UNIT_ROWS))
        # a label with few rows in a cell shares units with others
        sizes = sizes.withColumn("group", F.when(F.col("n") >= UNIT_ROWS // 4, F.col("label").cast("string"))) \
                     .withColumn("cuts", F.when(F.col("group").isNotNull(), F.ceil(F.col("n") / UNIT_ROWS)))
        rows = self.rows.join(stage(sizes.drop("n"), "negatives-sizes"), ["label", "cell"])
        part = F.when(F.col("group").isNull(), F.pmod(F.xxhash64("label"), F.lit(share))) \
                .otherwise(F.pmod(F.xxhash64("vec_id", "x"), F.col("cuts")))
        rows = rows.select("vec_id", F.col("label").cast("string").alias("label"), "x", "cell",
                           F.xxhash64("cell", F.col("group").isNull(), F.coalesce("group", F.lit("")), part).alias("unit"))
        size, kind, m2 = self.size, self.kind, self.m2

        def tree(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("vec_id")
            x = np.frombuffer(b"".join(frame["x"]), kind).reshape(len(frame), size)
            labels, codes = np.unique(frame["label"].to_numpy(str), return_inverse=True)
            data = _dump(x=x, ids=frame["vec_id"].to_numpy(np.int64), labels=labels, codes=codes,
                         **CoverTree(x, m2).nodes)
            return pd.DataFrame({"unit": frame["unit"].iloc[:1], "cell": frame["cell"].iloc[:1], "tree": [data]})

        return stage(rows.groupBy("unit").applyInPandas(tree, "unit long, cell long, tree binary"), "negatives-trees")

    def search(self, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
        """For each window of each query the best ``k`` rows of its own label, but
        not itself, or of the other labels: ``anchor_id``, ``tag``, ``vec_id``,
        ``score`` and ``rank``.

        ``queries``: vec_id, label, x and cell as in ``rows``, and ``windows``, an
        array of (tag, low, high)."""
        spark, size, kind, m2 = self.spark, self.size, self.kind, self.m2
        pivots, radii = self.pivots, self.radii
        cuts = F.ceil(F.col("n") / BLOCK_ROWS)
        blocks = queries.join(stage(queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "negatives-blocks"), "cell")
        blocks = blocks.select("vec_id", F.col("label").cast("string").alias("label"), "x", "windows",
                               F.xxhash64("cell", F.pmod(F.xxhash64("vec_id", "x"), cuts)).alias("block"))

        def gather(frame: pd.DataFrame) -> pd.DataFrame:
            x = np.frombuffer(b"".join(frame["x"]), kind).reshape(len(frame), size)
            w = [(i, v["tag"], v["low"], v["high"]) for i, ws in enumerate(frame["windows"]) for v in ws]
            w = np.array(w, np.int64).reshape(-1, 4)
            # cells in which some window can be met
            q = x.astype(np.float64)
            length = np.sqrt(np.einsum("ij,ij->i", q, q) * m2)[:, None]
            a = np.arccos(np.clip(np.divide(q @ pivots.T, length, out=np.zeros((len(q), len(pivots))), where=length > 0), -1, 1))
            slack = 1e-7 * length + 1e-6
            high = (length * np.cos(np.maximum(0, a - radii)) + slack)[w[:, 0]]
            low = (length * np.cos(np.minimum(np.pi, a + radii)) - slack)[w[:, 0]]
            cells = np.flatnonzero(((high >= w[:, 2:3]) & (low <= w[:, 3:4])).any(axis=0))
            data = _dump(x=x, ids=frame["vec_id"].to_numpy(np.int64), labels=frame["label"].to_numpy(str), windows=w)
            return pd.DataFrame({"block": frame["block"].iloc[:1], "cells": [cells], "data": [data]})

        blocks = stage(blocks.groupBy("block").applyInPandas(gather, "block long, cells array<long>, data binary"), "negatives-queries")
        pairs = blocks.select("block", F.explode("cells").alias("cell")).join(self.units, "cell").join(
            blocks.select("block", "data"), "block")
        n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        pairs = pairs.repartition(n, "block", F.pmod(F.col("unit"), F.lit(n))).sortWithinPartitions("block", "unit")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, queries, found = None, None, []

            def results() -> pa.RecordBatch:
                rows = [(a, f.tags[j], int(i), int(s)) for a, f in zip(queries["ids"].tolist() if found else (), found)
                        for j in range(len(f.tags)) for s, i in zip(*f.best[j])]
                return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 4,
                                       names=["anchor_id", "tag", "vec_id", "score"])

            for b in batches:
                for i in range(b.num_rows):
                    if b.column("block")[i].as_py() != block:
                        if found:
                            yield results()
                        block, queries, found = b.column("block")[i].as_py(), _load(b.column("data")[i].as_py()), []
                        w = queries["windows"]
                        q = queries["x"].astype(np.float64)
                        if m2 >= EXACT:  # m2 bounds every product
                            q = queries["x"].astype(object)
                        cuts = np.searchsorted(w[:, 0], np.arange(len(q) + 1))
                        for x, y in zip(cuts, cuts[1:]):
                            f = Found(w[x:y, 2].copy(), w[x:y, 3], k)
                            f.tags = w[x:y, 1].tolist()
                            found.append(f)
                    t = _load(b.column("tree")[i].as_py())
                    tree = CoverTree(t["x"], m2, t)
                    for v, own, label, f in zip(q, queries["ids"], queries["labels"], found):
                        same = (t["labels"] == label)[t["codes"]]
                        allowed = same & (t["ids"] != own) if same_label else ~same
                        if len(f.tags) and allowed.any():
                            f.ids = t["ids"]
                            tree.search(v, f, allowed)
            if found:
                yield results()

        out = pairs.select("block", "unit", "tree", "data").mapInArrow(run, "anchor_id long, tag long, vec_id long, score long")
        best = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id")
        return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """``rows`` (vec_id, label, x) as from ``prepared``; ``anchors`` picks the anchors.
    A negative scores between ``low`` and ``high`` percent of the positive."""
    index = Index(rows)
    window = lambda tag, a, b: F.struct(tag.cast("long").alias("tag"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    asked = index.rows.filter(anchors).drop("square")
    all_scores = F.array(window(F.lit(0), F.lit(-TOP), F.lit(TOP)))
    near = stage(index.search(asked.withColumn("windows", all_scores), positives, True), "negatives-positives")
    percent = lambda p: F.col("score").cast("decimal(38,0)") * p / 100
    ranges = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(window(F.col("vec_id"), F.ceil(percent(low)), F.floor(percent(high)))).alias("windows"))
    found = index.search(asked.join(ranges, "vec_id").withColumn(
        "windows", F.filter("windows", lambda w: w.low <= w.high)), negatives, False)
    scores = near.select("anchor_id", F.col("vec_id").alias("tag"), F.col("score").alias("positive_score"))
    return found.join(scores, ["anchor_id", "tag"]).select(
        "anchor_id", F.col("tag").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", label,
                    F.transform("embedding", lambda c: c.cast("double") * 256))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
negatives AS (
  SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
  FROM positives JOIN scores USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
