"""Decision trees as rules (M7): fitted by aggregations, compiled into a table
of rules and into one native CASE expression.

``fit`` grows a binary CART tree (Gini impurity, balanced class weights) level
by level over all rows, with every distinct value as a candidate: values are
counted per node and feature (combining before the shuffle), prefix sums of any
size give the class counts left of each, and one row per node comes back to the
driver. ``from_model`` reads the same nodes from a fitted ``pyspark.ml`` tree.
A tree is small (``2 ** max_depth`` leaves); scoring it is an expression, with no
model object, vector or Python on the executors.

A row without a value for a feature isn't used to fit; where a rule asks for
such a value, scoring goes to the right, as NULL fails the comparison.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.sequence import materialize, running_sums


@dataclass
class Node:
    """A leaf, or a split ``feature <= threshold`` (or ``feature in levels``)."""

    counts: tuple = ()
    weights: tuple = ()
    predicted: int | None = None
    feature: str | None = None
    threshold: float | None = None
    levels: tuple | None = None
    left: Node | None = None
    right: Node | None = None
    path: list = field(default_factory=list)

    @property
    def prediction(self) -> int:
        if self.predicted is not None:
            return self.predicted
        scores = [c * w for c, w in zip(self.counts, self.weights)]
        return scores.index(max(scores))  # the lower class on ties

    def test(self) -> Column:
        if self.levels is not None:
            return F.col(self.feature).isin(*self.levels)
        return F.col(self.feature) <= F.lit(self.threshold)

    def text(self, left: bool) -> str:
        if self.levels is not None:
            inside = ", ".join(f"{v:g}" for v in self.levels)
            return f"{self.feature} {'in' if left else 'not in'} ({inside})"
        return f"{self.feature} {'<=' if left else '>'} {self.threshold:.4f}"


def leaves(node: Node, path: Sequence[str] = ()) -> list[tuple[Node, tuple[str, ...]]]:
    """The leaves from left to right with the conditions that lead to them."""
    if node.left is None:
        return [(node, tuple(path))]
    return leaves(node.left, (*path, node.text(True))) + leaves(node.right, (*path, node.text(False)))


def expression(node: Node, value=lambda leaf, number: leaf.prediction) -> Column:
    """The tree as nested CASE expressions; ``value`` gives a leaf's result from
    the leaf and its number (from 1, left to right)."""
    numbers = {id(leaf): i for i, (leaf, _) in enumerate(leaves(node), 1)}

    def case(n: Node) -> Column:
        if n.left is None:
            return F.lit(value(n, numbers[id(n)]))
        return F.when(n.test(), case(n.left)).otherwise(case(n.right))
    return case(node)


def rules(df: DataFrame, tree: Node, label: str) -> DataFrame:
    """One row per leaf: ``rule_no``, ``rule``, ``class``, and over ``df`` its
    ``support`` and ``hits`` (rows whose label is the rule's class)."""
    spark = df.sparkSession
    table = spark.createDataFrame([(i, " AND ".join(path) or "true", leaf.prediction)
                                   for i, (leaf, path) in enumerate(leaves(tree), 1)],
                                  "rule_no int, rule string, class int")
    found = df.select(expression(tree, lambda leaf, number: number).alias("rule_no"), label) \
              .groupBy("rule_no", label).agg(F.count(F.lit(1)).alias("_n"))
    sums = table.join(found, "rule_no", "left").groupBy("rule_no", "rule", "class").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(F.col(label) == F.col("class"), F.col("_n"))), F.lit(0)).alias("hits"))
    return sums


def fit(df: DataFrame, features: Sequence[str], label: str, max_depth: int = 3) -> Node:
    """Fit a tree on a 0/1 ``label``; each class weighs as much as the other.
    The best split of a node has the highest sum of squared class weights over
    total weight of both sides; ties go to the earlier feature, then to the
    lower value. Its threshold is midway to the next value of the node."""
    rows = materialize(df.select(*features, F.col(label).cast("int").alias("_y"))
                         .filter(F.col("_y").isin(0, 1)).dropna(subset=list(features)), "tree-rows")
    counts = rows.agg(F.count_if(F.col("_y") == 0), F.count_if(F.col("_y") == 1)).first()
    weights = tuple(sum(counts) / (2 * c) if c else 0.0 for c in counts)
    root = Node(tuple(counts), weights)
    open_nodes = {1: root}
    for _ in range(max_depth):
        open_nodes = {k: n for k, n in open_nodes.items() if min(n.counts) > 0}
        if not open_nodes:
            break
        best = _best_splits(_with_node(rows, root, open_nodes), features, open_nodes, weights)
        grown = {}
        for r in best:
            n = open_nodes[r["node"]]
            n.feature, n.threshold = features[r["f"]], (r["v"] + r["next"]) / 2
            n.left = Node((r["l0"], r["l1"]), weights)
            n.right = Node((n.counts[0] - r["l0"], n.counts[1] - r["l1"]), weights)
            grown |= {2 * r["node"]: n.left, 2 * r["node"] + 1: n.right}
        open_nodes = grown
    return root


def _with_node(rows: DataFrame, root: Node, open_nodes: dict[int, Node]) -> DataFrame:
    numbers = {id(n): k for k, n in open_nodes.items()}
    node = expression(root, lambda leaf, _: numbers.get(id(leaf), 0))
    return rows.withColumn("node", node).filter("node > 0")


def _best_splits(rows: DataFrame, features: Sequence[str], open_nodes: dict[int, Node], weights) -> list:
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])
    values = rows.select("node", "_y", F.explode(pairs).alias("p")).groupBy("node", "p.f", "p.v").agg(
        F.count_if(F.col("_y") == 0).alias("c0"), F.count_if(F.col("_y") == 1).alias("c1"))
    values = materialize(values, "tree-values")
    left = running_sums(values, {"l0": "c0", "l1": "c1"}, ["v"], ["node", "f"])
    of_node = lambda i: F.coalesce(*[F.when(F.col("node") == k, n.counts[i]) for k, n in open_nodes.items()])
    w0, w1 = (F.lit(float(w)) for w in weights)

    def purity(a, b):
        x, y = a * w0, b * w1
        return (x * x + y * y) / (x + y)

    r0, r1 = of_node(0) - F.col("l0"), of_node(1) - F.col("l1")
    cuts = left.filter((r0 + r1) > 0)  # something is left on the right
    score = purity(F.col("l0"), F.col("l1")) + purity(r0, r1)
    best = cuts.groupBy("node").agg(F.max(F.struct(
        score.alias("score"), (-F.col("f")).alias("f"), (-F.col("v")).alias("v"), "l0", "l1")).alias("b")) \
        .select("node", (-F.col("b.f")).alias("f"), (-F.col("b.v")).alias("v"), "b.l0", "b.l1")
    best = materialize(best, "tree-best")  # one row per open node
    after = values.select(F.col("node").alias("n2"), F.col("f").alias("f2"), F.col("v").alias("v2"))
    following = after.join(F.broadcast(best), (F.col("n2") == F.col("node")) & (F.col("f2") == F.col("f"))
                           & (F.col("v2") > F.col("v")))
    return following.groupBy("node", "f", "v", "l0", "l1").agg(F.min("v2").alias("next")).collect()


def from_model(model, features: Sequence[str]) -> Node:
    """The nodes of a fitted ``pyspark.ml`` decision tree classifier."""
    def read(j) -> Node:
        n = Node(predicted=int(j.prediction()))
        if j.subtreeDepth() > 0:
            split = j.split()
            n.feature = features[split.featureIndex()]
            if "Continuous" in split.getClass().getSimpleName():
                n.threshold = split.threshold()
            else:
                n.levels = tuple(split.leftCategories())
            n.left, n.right = read(j.leftChild()), read(j.rightChild())
        return n
    return read(model._java_obj.rootNode())
