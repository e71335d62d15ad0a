"""Graphs of shots, features and tracks: components, merged tracks, neighbourhoods, partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import broadcast_if_small, checkpointed, join_splitting_hot, release, sorted_unique, written

#: Edges that one task may finish.
TASK_EDGES = 1_000_000
#: (ends u, ends v) of edges to (sorted distinct nodes, the root of each).
Kernel = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
from .observations import good_tracks


def smallest_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that the edges (u, v) link each to), by passing labels along edges and shortening the chains."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def _gathered(batches: Iterator[pd.DataFrame], names: list[str]) -> list[np.ndarray] | None:
    parts = [[b[c].to_numpy() for c in names] for b in batches if len(b)]
    return [np.concatenate(x) for x in zip(*parts)] if parts else None


def stars(edges: DataFrame, kernel: Kernel = smallest_labels) -> DataFrame:
    """node, root for the edges (u, v: long numbers) of each partition by themselves; roots come with themselves. Nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = _gathered(batches, ["u", "v"])
        if got:
            nodes, roots = kernel(*got)
            yield pd.DataFrame({"node": nodes, "root": roots})

    return edges.mapInPandas(run, "node long, root long")


def hooked(all_stars: DataFrame, kernel: Kernel = smallest_labels) -> DataFrame:
    """node, root, outer: the stars of all partitions brought together by node and joined within each new partition.

    A node has one row that names the root it has here. ``outer`` rows are the edges that are left: a node that is a
    root of some star may be linked elsewhere, too. One shuffle, of two numbers a node and partition that holds it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = _gathered(batches, ["node", "root"])
        if got:
            node, root = got
            here, top = kernel(node, root)
            told = sorted_unique(node)
            yield pd.DataFrame({"node": told, "root": top[np.searchsorted(here, told)], "outer": False})
            # every root that another node here points to, or that is told here to be one, stays in the graph
            outer = sorted_unique(np.concatenate([root[node != root], node[node == root]]))
            up = top[np.searchsorted(here, outer)]
            yield pd.DataFrame({"node": outer[outer != up], "root": up[outer != up], "outer": True})

    return all_stars.repartition("node").mapInPandas(run, "node long, root long, outer boolean")


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, label (the smallest node of its component) for edges (u, v).

    Edges of long numbers are first contracted within partitions, and once more after a shuffle by node. Of what is
    left, one task settles at most ``task_edges`` edges, alternating star rounds over tables any number.
    """
    e = edges.where("u is not null and v is not null").select("u", "v")
    if not isinstance(edges.schema["u"].dataType, T.LongType):
        return _star_rounds(e)
    here = written(hooked(stars(e)))
    left = written(here.where("outer").select(F.col("node").alias("u"), F.col("root").alias("v")))
    small = left.count() <= task_edges
    rest = written(stars(left.coalesce(1)).withColumnRenamed("root", "label") if small else _star_rounds(left))
    rest = broadcast_if_small(rest.select(F.col("node").alias("root"), F.col("label").alias("_top")), rest.count(), 64)
    return here.where("not outer").join(rest, "root", "left").select("node", F.coalesce("_top", "root").alias("label"))


def _star_rounds(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for edges (u, v), by alternating large and small stars.

    Each round links the neighbours of every node to its smallest one, first the larger neighbours, then the
    others and the node itself; it stops when no edge changes. Tables are written between rounds.
    """
    e = edges.where("u is not null and v is not null").select("u", "v")
    lone = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    cur = written(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = written(nxt)
        same = nxt.count() == cur.count() and nxt.exceptAll(cur).limit(1).count() == 0
        release(cur, large)
        cur = nxt
        if same:
            break
    return lone.join(cur.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def tracks_from_matches(matches: DataFrame, min_length: int = 2) -> DataFrame:
    """shot_id, feature_id, track_id: good components of matched features, named by their smallest (shot, feature)."""
    ok = matches.where("im1 is not null and im2 is not null and f1 >= 0 and f2 >= 0").select("im1", "f1", "im2", "f2").distinct()
    ends = ok.select(F.col("im1").alias("shot_id"), F.col("f1").alias("feature_id")).unionByName(ok.select(F.col("im2").alias("shot_id"), F.col("f2").alias("feature_id"))).distinct()
    # components of 64-bit numbers aggregate by hash; structs would sort. A number shared by two features is looked for
    number = lambda s, f: F.xxhash64(F.col(s), F.col(f))
    nodes = written(ends.withColumn("node", number("shot_id", "feature_id")))
    node = number
    if nodes.groupBy("node").count().where("count > 1").limit(1).count():
        node = lambda s, f: F.struct(F.col(s).alias("shot_id"), F.col(f).alias("feature_id"))
        nodes = nodes.withColumn("node", node("shot_id", "feature_id"))
    c = connected_components(ok.select(node("im1", "f1").alias("u"), node("im2", "f2").alias("v")))
    placed = written(nodes.join(c, "node").select("shot_id", "feature_id", "label"))
    least = placed.groupBy("label").agg(F.min(F.struct("shot_id", "feature_id")).alias("first"))
    named = join_splitting_hot(placed, least, "label")
    obs = named.select("shot_id", "feature_id", F.concat_ws("#", "first.shot_id", "first.feature_id").alias("track_id"))
    return obs.join(good_tracks(obs, min_length).select("track_id"), "track_id", "left_semi")


def merge_tracks(managers: dict[str, DataFrame]) -> DataFrame:
    """name, track_id, merged_id: tracks of several runs that share an observation become one, named by the smallest."""
    all_ = None
    for name, obs in managers.items():
        o = obs.select("shot_id", "feature_id", F.concat(F.lit(name + ":"), "track_id").alias("t")).distinct()
        all_ = o if all_ is None else all_.unionByName(o)
    first = all_.groupBy("shot_id", "feature_id").agg(F.min("t").alias("u"))
    links = all_.join(first, ["shot_id", "feature_id"]).select("u", F.col("t").alias("v")).distinct()
    c = connected_components(links)
    return c.select(F.substring_index("node", ":", 1).alias("name"), F.expr("substring(node, instr(node, ':') + 1)").alias("track_id"), F.col("label").alias("merged_id"))


def shot_neighbourhood(pairs: DataFrame, centre: str, radius: int, min_common: int, max_interior: int) -> DataFrame:
    """shot_id, ring: shots within ``radius`` steps of ``centre`` by pairs (im1, im2, n_common); ring ``radius`` is the boundary.

    Interior shots are taken in order of shared tracks until there are ``max_interior``.
    """
    spark = pairs.sparkSession
    strong = checkpointed(pairs.where(F.col("n_common") >= min_common))
    both = strong.select("im1", "im2", "n_common").unionByName(strong.select(F.col("im2").alias("im1"), F.col("im1").alias("im2"), "n_common"))
    inside = spark.createDataFrame([(centre, 0)], "shot_id string, ring int")
    for k in range(1, radius + 1):
        reach = both.join(inside.select(F.col("shot_id").alias("im1")), "im1", "left_semi")
        new = reach.groupBy(F.col("im2").alias("shot_id")).agg(F.sum("n_common").alias("n")).join(inside, "shot_id", "left_anti")
        if k < radius:
            room = max_interior - inside.count()
            if room <= 0:
                inside = inside.unionByName(new.select("shot_id", F.lit(radius).alias("ring")))
                return inside
            new = new.orderBy(F.desc("n"), "shot_id").limit(room)
        inside = inside.unionByName(new.select("shot_id", F.lit(k).alias("ring")))
    return inside


def clustered(points: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """points (id, lat, lon) with ``submodel``: k-means with about ``size`` points in each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    n = points.count()
    k = max(2, -(-n // size))
    if n < 2:
        return points.withColumn("submodel", F.lit(0))
    v = VectorAssembler(inputCols=["lat", "lon"], outputCol="_v").transform(points)
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="submodel", maxIter=20).fit(v).transform(v).drop("_v")
