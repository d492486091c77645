"""Graph operators: connected components and structural classes, as iterated joins with lineage cut each round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.session import cut, forget


#: Links that one task takes at once: some 100 MB.
SMALL = 1_000_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = SMALL) -> DataFrame:
    """(node, root): root is the least node that edges, taken both ways, connect with node.

    Every round gathers each node with its least neighbour and leaves one node of each cluster, with the links between
    clusters: half the nodes at most. When no more than `small` links are left, one task joins them. Least values are
    pre-aggregated before they move; look-ups join against tables with one row for each node, so a node with very many
    neighbours can be split over tasks.
    """
    one = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    links, clusters = cut(one.select(*ordered).distinct()), []
    while links.count() > small:
        star = _clusters(links)
        ends = [star.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root")) for n in ("a", "b")]
        between = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b")
        fewer = cut(between.select(*ordered).distinct())
        forget(links)
        links = fewer
        clusters.append(star)
    kind = links.schema["a"].dataType.simpleString()
    labels = links.repartition(1).mapInArrow(_joined, f"node {kind}, root {kind}")
    for star in reversed(clusters):
        of = labels.select(F.col("node").alias("of"), F.col("root").alias("last"))
        labels = star.join(of, star.root == of.of, "left").select("node", F.coalesce("last", "root").alias("root"))
    labels = cut(labels)
    forget(links, *clusters)
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))


def _clusters(links: DataFrame) -> DataFrame:
    """(node, root) of clusters: the ways from each node to its least neighbour end in a pair, whose lesser node is the root."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = cut(both.groupBy("a").agg(F.min(F.when(F.col("a") != F.col("b"), F.col("b"))).alias("m")).select(F.col("a").alias("node"), F.coalesce("m", "a").alias("root")))
    first = True
    while True:
        of = up.select(F.col("node").alias("of"), F.col("root").alias("next"))
        root = F.when(F.col("next") == F.col("node"), F.least("node", "root")).otherwise(F.col("next")) if first else F.col("next")
        found = cut(up.join(of, up.root == of.of).select("node", root.alias("root"), (root != F.col("root")).alias("moved")))
        forget(up)
        up = found
        if not first and up.where("moved").isEmpty():
            return up
        first = False


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links at once; at least every other round halves the roots that have links."""
    got = list(batches)
    if not got:
        return
    ends = pa.concat_arrays([b.column(k) for k in (0, 1) for b in got]).dictionary_encode()
    a, b = np.split(ends.indices.to_numpy(), 2)
    up = np.arange(len(ends.dictionary))
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != (top := up[up])).any():
            up = top
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    for i in range(0, len(up), 10_000):
        yield pa.RecordBatch.from_arrays([ends.dictionary[i : i + 10_000], ends.dictionary.take(pa.array(up[i : i + 10_000]))], ["node", "root"])


def inherited(nodes: DataFrame, node: str, base: str, value: str) -> DataFrame:
    """(node, value): a node's own value, else that of the nearest base with one, null without any; the greatest where a node has several rows.

    Every round replaces the base of a row without value by what the base's rows say by then, so the way to go halves.
    Rows that are open after as many rounds as the longest way takes go round in circles, which give no value.
    """
    rows = nodes.select(F.col(node).alias("node"), F.col(base).alias("base"), F.col(value).alias("value"))
    state = cut(rows.where("value IS NOT NULL OR base IS NOT NULL").withColumn("base", F.when(F.col("value").isNull(), F.col("base"))).distinct())
    for _ in range(state.count().bit_length() + 1):
        if state.where("base IS NOT NULL").isEmpty():
            break
        of = state.where("node IS NOT NULL").select(F.col("node").alias("of"), F.col("base").alias("next"), F.col("value").alias("found"))
        step = state.where("base IS NOT NULL").join(of, F.col("base") == F.col("of")).select("node", F.col("next").alias("base"), F.col("found").alias("value"))
        found = cut(state.where("base IS NULL").unionByName(step).distinct())
        forget(state)
        state = found
    values = state.select("node", "value").unionByName(rows.select("node", "value"))
    return values.groupBy("node").agg(F.max("value").alias("value")).select(F.col("node").alias(node), F.col("value").alias(value))


def structural_classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, class): the coarsest classes in which equal nodes have equal signatures and, edge by edge, targets of equal classes.

    nodes (node, signature), edges (node, place, target). Classes are named by hashes of what they are made of, so a round is
    a join and an aggregate without any global order; rounds end when their number no longer grows. The least node of a class
    stands for it.
    """
    state = cut(nodes.select("node", F.xxhash64("signature").alias("class"), F.xxhash64("signature").alias("own")))
    count = state.select("class").distinct().count()
    while True:
        targets = edges.join(state.select(F.col("node").alias("target"), F.col("class").alias("of")), "target")
        shape = targets.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "of"))).alias("shape"))
        found = cut(state.join(shape, "node", "left").select("node", F.xxhash64("own", "class", "shape").alias("class"), "own"))
        forget(state)
        state, was = found, count
        count = state.select("class").distinct().count()
        if count == was:
            least = state.groupBy("class").agg(F.min("node").alias("representative"))
            return state.join(least, "class").select("node", "representative")
