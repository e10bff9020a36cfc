"""Saved trees as a table, and what follows from the table alone: split counts and a compiled score.

The learners keep their trees to themselves; saving a member writes one row per node. Read back,
these rows give the learner's split-count importances as an aggregate, and a score that
needs no learner: every tree becomes nested conditions in one generated expression.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failcast.scratch import shared_dir


def node_table(spark: SparkSession, members, path: str | None = None) -> DataFrame:
    """Nodes of boosted-tree members: member, tree, node, prediction, gain, left, right (-1 for a leaf), feature (-1),
    left_values (threshold, or the categories that go left), n_categories (-1 for a number) and the tree's weight.

    The members are saved under ``path`` (the shared scratch folder by default) and read back together."""
    path = path or shared_dir(spark, "materialized", f"nodes-{uuid.uuid4().hex}")
    for i, m in enumerate(members):
        m.write().overwrite().save(f"{path}/{i}")
    member = lambda part: F.regexp_extract("_metadata.file_path", rf"/(\d+)/{part}/[^/]*$", 1).cast("int").alias("member")
    weights = spark.read.parquet(f"{path}/*/treesMetadata").toDF("tree", "metadata", "weight").select(member("treesMetadata"), "tree", "weight")
    n = "nodeData"
    nodes = spark.read.parquet(f"{path}/*/data").select(
        member("data"), F.col("treeID").alias("tree"), F.col(f"{n}.id").alias("node"), f"{n}.prediction", f"{n}.gain", F.col(f"{n}.leftChild").alias("left"),
        F.col(f"{n}.rightChild").alias("right"), F.col(f"{n}.split.featureIndex").alias("feature"),
        F.col(f"{n}.split.leftCategoriesOrThreshold").alias("left_values"), F.col(f"{n}.split.numCategories").alias("n_categories"))
    return nodes.join(weights, ["member", "tree"])


def split_counts(nodes: DataFrame, names) -> DataFrame:
    """How often each model input splits a node, summed over all members and trees (0 for an unused one)."""
    spark = nodes.sparkSession
    inputs = spark.createDataFrame(list(enumerate(names)), "number int, feature string")  # a row a model input
    used = nodes.where("left >= 0").groupBy(F.col("feature").alias("number")).agg(F.count(F.lit(1)).alias("splits"))
    return inputs.join(used, "number", "left").select("feature", F.coalesce("splits", F.lit(0)).cast("long").alias("splits"))


def _condition(node, inputs) -> str:
    value = f"`{inputs[node.feature]}`"
    if node.n_categories < 0:
        return f"{value} <= {node.left_values[0]!r}D"
    return f"{value} IN ({', '.join(f'{v!r}D' for v in node.left_values)})" if node.left_values else "false"


def _tree(nodes: dict, at: int, inputs) -> str:
    node = nodes[at]
    if node.left < 0:
        return f"{node.prediction!r}D"
    return f"if({_condition(node, inputs)}, {_tree(nodes, node.left, inputs)}, {_tree(nodes, node.right, inputs)})"


def compiled_score(nodes: DataFrame, inputs) -> Column:
    """The ensemble's probability as one expression over the columns ``inputs`` (in the order of the features).

    A member's margin is the weighted sum of its trees and its probability 1 / (1 + exp(-2 margin)); the ensemble's
    is the members' mean. Only the model's nodes come to the driver (members x trees x nodes). A model whose
    trees outgrow one generated method (64 KB; some 300 splits) is run by Spark outside of whole-stage code."""
    members: dict = {}
    for r in nodes.collect():
        members.setdefault(r.member, {}).setdefault(r.tree, (r.weight, {}))[1][r.node] = r
    chances = []
    for _, trees in sorted(members.items()):
        margin = " + ".join(f"{w!r}D * {_tree(by_node, 0, inputs)}" for _, (w, by_node) in sorted(trees.items()))
        chances.append(f"1D / (1D + exp(-2D * ({margin})))")
    return F.expr(f"({' + '.join(chances)}) / {float(len(chances))!r}D")
