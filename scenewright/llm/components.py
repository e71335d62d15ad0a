"""Connected components by Borůvka hooking: smallest outgoing edges, pointer doubling, relabelling.

The same rounds run twice: in arrays over the edges of one partition, which needs no shuffle, and over whole
tables for what no partition could finish.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..runtime import broadcast_if_small, checkpointed, clean_key, release, sorted_unique, written

#: Edges that one task may finish; rows that make a group hot; keys that may share a hash and be told apart by name.
TASK_EDGES, HOT_ROWS, MOST_CLASHES = 1_000_000, 200_000, 10_000


def boruvka(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): of each node the smallest node that the edges (u, v) link it to, by rounds over whole arrays.

    Each round every component takes its smallest neighbour for parent, of two that take one another the
    smaller becomes a root; the trees collapse by pointer doubling, and the edges are relabelled and deduplicated.
    """
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    n = len(nodes)
    own = np.arange(n)
    root = own.copy()
    a, b = ends[: len(u)], ends[len(u) :]
    while True:
        apart = a != b
        if not apart.any():
            return nodes, nodes[root]
        edge = sorted_unique(np.minimum(a, b)[apart].astype(np.int64) * n + np.maximum(a, b)[apart])
        a, b = edge // n, edge % n
        parent = np.full(n, n)
        np.minimum.at(parent, a, b)
        np.minimum.at(parent, b, a)
        parent = np.where(parent == n, own, parent)
        parent = np.where((parent[parent] == own) & (own < parent), own, parent)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        # the root of a tree need not be its smallest node
        least = np.full(n, n)
        np.minimum.at(least, parent, own)
        parent = least[parent]
        root = parent[root]
        a, b = parent[a], parent[b]


def _pick_smallest(edges: DataFrame) -> DataFrame:
    """node, parent: the other end of the smallest edge at each node, edges ordered by (smaller end, larger end).

    That end is the smallest neighbour: the edge to a neighbour below the node comes before any edge to
    one above it. The order is total on undirected edges, so the picks form a forest but for pairs that
    pick one another.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent"))


def _collapse(picked: DataFrame) -> DataFrame:
    """Pointer doubling until every node points at its root.

    Two nodes that pick one another find themselves at the second pointer; both then take the smaller.
    """
    tree = written(picked)
    while True:
        old = tree
        up = tree.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        top = F.when(F.col("next") == F.col("node"), F.least("node", "parent")).otherwise(F.col("next"))
        tree = written(tree.select("node", "parent").join(up, "parent").select("node", top.alias("parent"), (F.col("next") != F.col("parent")).alias("moved")))
        release(old)
        if tree.where("moved").limit(1).count() == 0:
            return tree


def _by_rounds(live: DataFrame, task_edges: int) -> DataFrame:
    """node, root for distinct edges (u < v) by distributed rounds; what fits one task is finished there by the same rounds."""
    label = None
    while n := live.count():
        if n <= task_edges:
            tree = written(graph.stars(live.coalesce(1), boruvka).withColumnRenamed("root", "parent"))
            release(live)
            live = live.limit(0)
        else:
            tree = _collapse(_pick_smallest(live))
            a = live.join(tree.select(F.col("node").alias("u"), F.col("parent").alias("ru")), "u").select("v", "ru")
            b = a.join(tree.select(F.col("node").alias("v"), F.col("parent").alias("rv")), "v").where("ru <> rv")
            old, live = live, written(b.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
            release(old)
        if label is None:
            label = written(tree.select("node", F.col("parent").alias("root")))
        else:
            step = tree.select(F.col("node").alias("root"), F.col("parent").alias("top"))
            old, label = label, written(label.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
            release(old)
        release(tree)
    release(live)
    return label


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, root for every node of ``edges`` (u, v: long numbers); the root is a node of its component.

    First the edges of each partition are contracted where they lie, and again after one shuffle by node; of
    tracks and chains little is left. On the rest each round every component picks its smallest outgoing
    edge, the trees so made collapse by pointer doubling, and the edges are relabelled and deduplicated (joins
    on a hub's label are left to adaptive skew splitting: no order or group is needed after them); a round at least
    halves the components that still have an edge, so n nodes need at most log2(n) rounds. At most ``task_edges``
    edges are finished by one task. Rows with a null end are left out; a row with equal ends makes a lone node.
    No edges give no rows. The driver only ever learns how many edges are left.
    """
    hooked = written(graph.hooked(graph.stars(edges.select("u", "v").where("u is not null and v is not null"), boruvka), boruvka))
    left = hooked.where("outer")
    live = written(left.select(F.least("node", "root").alias("u"), F.greatest("node", "root").alias("v")).distinct())
    top = _by_rounds(live, task_edges)
    found = hooked.where("not outer").select("node", "root")
    if top is None:
        return found
    top = broadcast_if_small(top.select(F.col("node").alias("root"), F.col("root").alias("top")), top.count(), 64)
    return found.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def grouped_records(links: DataFrame, hubs: DataFrame | None = None, hot_rows: int = HOT_ROWS, task_edges: int = TASK_EDGES) -> DataFrame:
    """kind, record_key, group_key from ``links`` (kind, a, b: the two keys of a link; a = b for a lone record)
    and ``hubs`` (kind, a, hub: records with equal kind and hub are linked; a hub is no record).

    ``group_key`` is the smallest key, by bytes, among all records linked directly or indirectly. The
    iteration runs on 64-bit hashes of the keys. Keys that share one are looked for first and take other hashes.
    Null keys are left out, repeated links count once. Groups of at least ``hot_rows`` records are named by a
    broadcast of their names, of which there are at most as many as records / ``hot_rows``.
    """
    links = links.select("kind", "a", "b").where("kind is not null and a is not null and b is not null")
    records = links.select("kind", F.explode(F.array("a", "b")).alias("record_key"))
    if hubs is not None:
        hubs = hubs.select("kind", "a", "hub").where("kind is not null and a is not null and hub is not null")
        records = records.unionByName(hubs.select("kind", F.col("a").alias("record_key")))
    numbered = F.xxhash64("kind", "record_key")
    number = lambda k: F.xxhash64(F.col("kind"), F.col(k))
    seed = 0
    while True:
        named = written(records.select(numbered.alias("node"), "kind", "record_key").repartition("node").distinct())
        clashes = checkpointed(named.groupBy("node").count().where("count > 1").select("node"))
        if not (n := clashes.count()):
            break
        if n > MOST_CLASHES:
            raise ValueError("the hash function fails on these keys")
        seed, taken = seed + 1, [r["node"] for r in clashes.collect()]

        def number(k: str, before=number, seed=seed, taken=taken) -> Column:
            return F.when(before(k).isin(taken), F.xxhash64(F.lit(seed), F.col("kind"), F.col(k))).otherwise(before(k))

        numbered = number("record_key")
        release(named)
    edges = links.select(number("a").alias("u"), number("b").alias("v"))
    if hubs is not None:
        edges = edges.unionByName(hubs.select(number("a").alias("u"), F.xxhash64(F.lit("hub"), F.col("kind"), F.col("hub")).alias("v")))
    roots = written(components(edges, task_edges))
    hot = checkpointed(roots.groupBy("root").count().where(F.col("count") >= hot_rows).select("root"))
    placed = named.join(roots, "node").select("kind", "record_key", "root")
    cold = placed.join(F.broadcast(hot), "root", "left_anti")
    out = cold.select("kind", "record_key", F.min("record_key").over(Window.partitionBy("root")).alias("group_key"))
    if hot.count():
        warm = placed.join(F.broadcast(hot), "root", "left_semi")
        least = warm.groupBy("root").agg(F.min("record_key").alias("group_key"))
        out = out.unionByName(warm.join(F.broadcast(least), "root").select("kind", "record_key", "group_key"))
    return out


def feature_links(matches: DataFrame) -> DataFrame:
    """Links of (shot, feature) records: rows of ``matches`` whose two features are both valid."""
    ok = matches.where("im1 is not null and im2 is not null and f1 >= 0 and f2 >= 0")
    key = lambda s, f: F.concat(F.col(s), F.lit("#"), F.col(f).cast("string"))
    return ok.select(F.lit("feature").alias("kind"), key("im1", "f1").alias("a"), key("im2", "f2").alias("b"))


def shot_links(gcps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, hubs) of shots: the point is the hub of all shots that any of its rows names; rows without an id are points of their own."""
    shots = F.filter(F.transform("observations", lambda o: clean_key(o["shot_id"])), lambda x: x.isNotNull())
    point = F.col("id").cast("string") if "id" in gcps.columns else F.lit(None).cast("string")
    rows = gcps.select(point.alias("id"), F.array_distinct(shots).alias("s")).where("size(s) > 0")
    shot = F.lit("shot").alias("kind")
    hubs = rows.where("id is not null").select(shot, F.explode("s").alias("a"), F.col("id").alias("hub")).distinct()
    return rows.where("id is null").select(shot, F.get("s", F.lit(0)).alias("a"), F.explode("s").alias("b")), hubs


def consolidate(matches: DataFrame, gcps: DataFrame) -> DataFrame:
    """Group identifiers of all features and of all shots: kind, record_key, group_key."""
    links, hubs = shot_links(gcps)
    return grouped_records(feature_links(matches).unionByName(links), hubs)
