"""Session-level helpers: tables, checkpoints, ordered partitions, size-checked broadcasts.

Everything here is written for executors that can be lost at any time: lineage is
only ever cut with ``DataFrame.checkpoint`` into the shared folder that the session
names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest estimated size, in bytes, of a side that is broadcast on purpose.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for local masters without a setting."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="scenewright-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder: lineage is cut and its true size known to the planner.

    Iterations use this instead of ``checkpoint()``, whose estimated sizes multiply from round to round.
    :func:`release` removes a table that nothing reads any more; what is left goes when Python ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_path = path
    if not _left:
        atexit.register(_clean)
    _left[path] = spark
    return out


def release(*dfs: DataFrame | None) -> None:
    """Removes tables made by :func:`written`; other frames and None are ignored."""
    for df in dfs:
        path = getattr(df, "_written_path", None)
        if path and _left.pop(path, None):
            fs, p = _filesystem(df.sparkSession, path)
            fs.delete(p, True)


_left: dict[str, SparkSession] = {}


def _clean() -> None:
    for path, spark in list(_left.items()):
        try:
            fs, p = _filesystem(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when ``rows`` (a counted bound) times ``row_bytes`` stays under ``limit``; else unchanged."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def clean_key(c: Column | str) -> Column:
    """Outer white space of any kind removed, lower case; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    trimmed = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(trimmed != "", trimmed)


def join_splitting_hot(left: DataFrame, right: DataFrame, key: str, hot_rows: int = 200_000, how: str = "inner") -> DataFrame:
    """Equi-join of ``left`` with a ``right`` that is unique by ``key``, safe for keys that hold a large share of ``left``.

    Keys with at least ``hot_rows`` rows number at most ``count(left) / hot_rows``; their right rows are
    broadcast and never shuffle the hot left rows, all other keys take the ordinary shuffle join.
    ``left`` is read more than once: give a checkpointed or otherwise cheap one.
    """
    if left.count() < hot_rows:
        return left.join(right, key, how)
    hot = left.groupBy(key).count().where((F.col("count") >= hot_rows) & F.col(key).isNotNull()).select(key)
    hot = checkpointed(hot)
    n = hot.count()
    if n == 0:
        return left.join(right, key, how)
    if n * 512 > BROADCAST_BYTES:  # billions of rows: leave the split to adaptive skew joins
        return left.join(right, key, how)
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    tagged = left.join(mark, key, "left")
    cold = tagged.where("_hot is null").drop("_hot").join(right, key, how)
    few = right.join(F.broadcast(hot), key, "left_semi")
    warm = tagged.where("_hot").drop("_hot").join(F.broadcast(few), key, how)
    return cold.unionByName(warm)


@dataclass
class OrderedPartitions:
    """Rows range-partitioned and sorted by (group, order), with the edges of every partition at hand.

    A group of any size spreads over as many partitions as its rows need; ``edges`` holds at most
    ``2 * halo`` rows a partition, so neighbours across a cut are known without moving the group.
    """

    df: DataFrame
    group: list[str]
    order: list[str]
    halo: int
    before: dict[int, pd.DataFrame] = field(default_factory=dict)
    after: dict[int, pd.DataFrame] = field(default_factory=dict)
    spanning: set = field(default_factory=set)

    def map(self, fn: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str) -> DataFrame:
        """``fn(rows, pid)`` once a partition: rows of it and of its halos, with ``_core`` true for its own rows."""
        before, after = self.before, self.after
        sent = self.df.sparkSession.sparkContext.broadcast((before, after))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [b for b in batches if len(b)]
            if not parts:
                return
            own = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
            pid = int(own["_pid"].iloc[0])
            own["_core"] = True
            pieces = []
            lead, tail = sent.value
            if pid in lead and len(lead[pid]):
                pieces.append(lead[pid].assign(_core=False))
            pieces.append(own)
            if pid in tail and len(tail[pid]):
                pieces.append(tail[pid].assign(_core=False))
            out = fn(pd.concat(pieces, ignore_index=True) if len(pieces) > 1 else own, pid)
            if out is not None and len(out):
                yield out

        return self.df.mapInPandas(run, schema)


def ordered_partitions(df: DataFrame, group: list[str], order: list[str], halo: int, then: Callable[[DataFrame], DataFrame] | None = None) -> OrderedPartitions:
    """Range-partition ``df`` by (group, order), checkpoint it and collect its partition edges.

    Rows whose group is null form one group of their own. What reaches the driver is at most
    ``2 * halo`` rows a partition. Range partitioning runs its input twice, once for a sample: ``then``
    (narrow, it keeps the keys) is applied after it and runs once.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(*keys)
    ranged = then(ranged) if then else ranged
    placed = checkpointed(ranged.sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, tail, n = None, None, 0
        for b in batches:
            if not len(b):
                continue
            head = b if head is None else pd.concat([head, b]) if len(head) < halo else head
            head = head.iloc[:halo]
            tail = b if tail is None else pd.concat([tail, b])
            tail = tail.iloc[-halo:]
            n += len(b)
        if n:
            yield head.assign(_side=0, _n=n)
            yield tail.assign(_side=1, _n=n)

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in placed.schema.fields), T.StructField("_side", T.IntegerType()), T.StructField("_n", T.LongType())])
    edges = placed.mapInPandas(ends, schema).toPandas()
    out = OrderedPartitions(placed, group, order, halo)
    if not len(edges):
        return out
    pids = sorted(edges["_pid"].unique())
    by = {(p, s): e.drop(columns=["_side"]).reset_index(drop=True) for (p, s), e in edges.groupby(["_pid", "_side"], sort=True)}
    key = lambda row: tuple("\0null" if pd.isna(row[g]) else row[g] for g in group)
    for i, p in enumerate(pids):
        first, last = key(by[p, 0].iloc[0]), key(by[p, 1].iloc[-1])
        got, need = [], halo
        for q in reversed(pids[:i]):  # a partition may hold fewer rows than the halo
            t = by[q, 1]
            if key(t.iloc[-1]) != first or need <= 0:
                break
            same = t[[key(r) == first for _, r in t.iterrows()]].iloc[-need:]
            got.insert(0, same)
            need -= len(same)
            if len(same) < len(t) or int(t["_n"].iloc[0]) > len(t):
                break
        if got:
            out.before[int(p)] = pd.concat(got, ignore_index=True).drop(columns=["_n"])
            out.spanning.add(first)
        got, need = [], halo
        for q in pids[i + 1 :]:
            t = by[q, 0]
            if key(t.iloc[0]) != last or need <= 0:
                break
            same = t[[key(r) == last for _, r in t.iterrows()]].iloc[:need]
            got.append(same)
            need -= len(same)
            if len(same) < len(t) or int(t["_n"].iloc[0]) > len(t):
                break
        if got:
            out.after[int(p)] = pd.concat(got, ignore_index=True).drop(columns=["_n"])
            out.spanning.add(last)
    return out


def group_codes(pdf: pd.DataFrame, group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the groups in sorted rows, and for each row the number of its group; nulls equal each other."""
    n = len(pdf)
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for g in group:
        v = pd.factorize(pdf[g], use_na_sentinel=True)[0]
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def ranked(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of ``keys``: range-partitioned, so no task sorts all rows.

    Rows with equal keys are placed anyhow. The driver gets one count a partition.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = checkpointed(placed)
    counts = {r["_pid"]: r["count"] for r in placed.groupBy("_pid").count().collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    offsets = df.sparkSession.createDataFrame([(p, n) for p, n in before.items()] or [(-1, 0)], "_pid int, _before long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_before") + inside).drop("_pid", "_at", "_before")


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """The distinct values in order. ``np.unique`` builds a hash table for this, which takes many times longer on long arrays of numbers."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
