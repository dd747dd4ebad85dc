"""Connected components of an edge table as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import checkpoint


def _once(edges: DataFrame) -> DataFrame:
    """Each edge once, without loops."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between the labels of their ends; an end without a label stays."""
    for end in ("u", "v"):
        edges = edges.join(labels.select(F.col("id").alias(end), "label"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    return edges


def _flattened(parents: DataFrame) -> DataFrame:
    """id and label: the end of the chain of parents that begins at id. Each round doubles how far a row sees."""
    while True:
        further = parents.select(F.col("id").alias("label"), F.col("label").alias("next"))
        now = checkpoint(parents.join(further, "label").select("id", F.col("label").alias("was"), F.col("next").alias("label")))
        parents = now.select("id", "label")
        if not now.filter("label <> was").limit(1).count():
            return parents


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id and label of every node of edges (u long, v long); the label is the smallest id that can be reached.

    Each round, every node follows its smallest neighbour, and theirs, to the end; then these ends take the nodes' places,
    and edges within one end go. At least half of the nodes that still have edges go in a round, so that few edges are
    left after the first. Rounds are checkpointed; only whether rows are left reaches the driver.

    known: labels from an earlier call. Edges then join its components, and its nodes are in the result.
    """
    rest, labels = edges.select("u", "v"), known
    if known is not None:
        rest = _relabelled(rest, known)
    rest = checkpoint(_once(rest))
    if known is not None:
        new = rest.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(known, "id", "left_anti")
        labels = known.union(new.select("id", F.col("id").alias("label")))
    while rest.limit(1).count():
        both = rest.union(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = _flattened(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("v")).select("id", F.least("id", "v").alias("label")))
        if labels is None:
            labels = parents
        else:
            moved = labels.join(parents.select(F.col("id").alias("label"), F.col("label").alias("lower")), "label", "left")
            labels = checkpoint(moved.select("id", F.coalesce("lower", "label").alias("label")))
        rest = checkpoint(_once(_relabelled(rest, parents)))
    return rest.select(F.col("u").alias("id"), F.col("v").alias("label")) if labels is None else labels
