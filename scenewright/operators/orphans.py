"""References to records that do not exist: Bloom filter first, exact join for what it lets through."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, clean_key, written

#: Bits of filter for each parent key, and the largest filter that is broadcast, in bytes.
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 32 << 20
_SEED = 7


def _word_and_mask(key, words: int):
    """A blocked filter: the hash picks one 64-bit word and four bits in it."""
    h = F.xxhash64(F.lit(_SEED), key)
    g = F.xxhash64(F.lit(_SEED + 1), key)
    mask = F.lit(0).cast("long")
    for i in range(4):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(h, F.lit(words)), mask


def bloom_filter(parents: DataFrame, key: str, max_bytes: int = MAX_FILTER_BYTES) -> tuple[np.ndarray, int]:
    """The filter over the distinct non-null ``key`` of ``parents`` as an array of words, and their number of rows.

    The array has a fixed upper bound, whatever the number of keys: beyond ``max_bytes`` the filter only
    becomes less selective, and the exact join has more to verify.
    """
    n = parents.count()
    words = max(64, min(max_bytes // 8, 1 << math.ceil(math.log2(max(n, 1) * BITS_PER_KEY / 64 + 1))))
    word, mask = _word_and_mask(F.col(key), words)
    filled = parents.where(F.col(key).isNotNull()).select(word.alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    bits = np.zeros(words, dtype=np.int64)
    # in columns, 16 bytes a word: toPandas makes Python rows first, 54 MB for 100,000 words
    for b in filled.toArrow().to_batches():
        bits[b.column("w").to_numpy()] = b.column("m").to_numpy()
    return bits, n


def with_maybe(refs: DataFrame, key: str, bits: np.ndarray) -> DataFrame:
    """Adds ``_maybe``: false where the filter proves that no parent has the key."""
    sent = refs.sparkSession.sparkContext.broadcast(bits)
    word, mask = _word_and_mask(F.col(key), len(bits))

    @F.pandas_udf("boolean")
    def probe(w: pd.Series, m: pd.Series) -> pd.Series:
        m = m.to_numpy(dtype=np.int64)
        return pd.Series((sent.value[w.to_numpy(dtype=np.int64)] & m) == m)

    return refs.withColumn("_maybe", probe(word, mask))


def lifetimes(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """One row a key: ``lives``, the array of its (start, end); a null start means since ever, a null end still there."""
    return (
        rows.select(clean_key(key).alias("ref_key"), F.struct(F.col(start).alias("s"), F.col(end).alias("e")).alias("life"))
        .where("ref_key is not null")
        .groupBy("ref_key")
        .agg(F.collect_set("life").alias("lives"))
    )


def orphan_references(refs: DataFrame, parents: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Each reference that no lifetime of its target holds, with its state and month.

    ``refs``: record_key, ref_key (cleaned, not null), at (time of the record, may be null).
    ``parents``: as of :func:`lifetimes`. Result: record_key, ref_key, ref_state, ref_month.

    References without a target are ``missing`` whatever their time. A record without a time can be
    judged in no other way, so its references to known targets are no cases. Rows given twice come
    out once. The exact join moves only what the filter lets through; its parent side is broadcast
    when counted small enough, otherwise the shuffle join is split by adaptive execution where a key
    is hot. Empty tables give an empty result; further columns are ignored.
    """
    refs = refs.select("record_key", "ref_key", "at").where("ref_key is not null and record_key is not null").distinct()
    parents = written(parents)
    bits, n = bloom_filter(parents, "ref_key", max_filter_bytes)
    refs = written(with_maybe(refs, "ref_key", bits))
    month = F.date_format("at", "yyyy-MM").alias("ref_month")
    proven = refs.where("not _maybe").select("record_key", "ref_key", F.lit("missing").alias("ref_state"), month)
    joined = refs.where("_maybe").join(broadcast_if_small(parents, n, 256), "ref_key", "left")
    live = F.exists("lives", lambda x: (x["s"].isNull() | (x["s"] <= F.col("at"))) & (x["e"].isNull() | (x["e"] > F.col("at"))))
    late = F.forall("lives", lambda x: x["s"].isNotNull() & (x["s"] > F.col("at")))
    state = F.when(F.col("lives").isNull(), "missing").when(F.col("at").isNull() | live, None).when(late, "late").otherwise("deleted")
    verified = joined.withColumn("ref_state", state).where("ref_state is not null").select("record_key", "ref_key", "ref_state", month)
    return proven.unionByName(verified)


def image_camera_references(images: DataFrame) -> DataFrame:
    """(record_key, ref_key, at) of ``images.camera_id``; a repeated delivery counts with the earliest time of its shot."""
    return (
        images.where("shot_id is not null")
        .groupBy(F.col("shot_id").alias("record_key"))
        .agg(F.min("ingested_at").alias("at"), F.array_distinct(F.transform(F.collect_set("camera_id"), clean_key)).alias("keys"))
        .select("record_key", F.explode("keys").alias("ref_key"), "at")
        .where("ref_key is not null")
    )


def gcp_shot_references(gcps: DataFrame) -> DataFrame:
    """(record_key, ref_key, at) of ``ground_control_points.observations.shot_id``."""
    rows = gcps.where("id is not null").repartition("id").select(F.col("id").alias("record_key"), "ingested_at", F.explode_outer("observations.shot_id").alias("s"))
    each = rows.groupBy("record_key", clean_key("s").alias("ref_key")).agg(F.min("ingested_at").alias("at"))
    # a point's time is that of its earliest row, also where that row names no shot
    first = F.min("at").over(Window.partitionBy("record_key"))
    return each.withColumn("at", first).where("ref_key is not null")


def image_lifetimes(images: DataFrame) -> DataFrame:
    """Images live from their earliest delivery until deleted."""
    shots = images.where("shot_id is not null").groupBy("shot_id").agg(F.min("ingested_at").alias("s"), F.max("deleted_at").alias("d"), F.count(F.when(F.col("deleted_at").isNull(), 1)).alias("n"))
    return lifetimes(shots.withColumn("e", F.when(F.col("n") == 0, F.col("d"))), "shot_id", "s", "e")


def find_orphans(images: DataFrame, cameras: DataFrame, gcps: DataFrame) -> DataFrame:
    """table_name, record_key, ref_key, ref_state, ref_month for both kinds of reference."""
    a = orphan_references(image_camera_references(images), lifetimes(cameras, "camera_id", "created_at", "deleted_at"))
    b = orphan_references(gcp_shot_references(gcps), image_lifetimes(images))
    out = a.withColumn("table_name", F.lit("images")).unionByName(b.withColumn("table_name", F.lit("ground_control_points")))
    return out.select("table_name", "record_key", "ref_key", "ref_state", "ref_month").distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, period and state."""
    return found.groupBy("table_name", "ref_month", "ref_state").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("record_key").alias("n_records"))
