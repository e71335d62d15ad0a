"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded documents."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary cuts text before merging.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Records of one pattern ordered in one task; bytes that a row of the plan takes at most for each source of its pattern.
BUCKET_ROWS = 100_000
_PLAN_BYTES = 128


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str = "text", name: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds the number of tokens of a public tokenizer; null texts have null."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(tokenizer)
        for b in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in b], dtype="Int64")

    return df.withColumn(name, count(F.col(text)))


class PatternFlow:
    """Min-cost flow from patterns to sources, whole arrays of patterns at a time.

    The k-th use of a token costs k - 1 whatever source it goes to, so successive shortest paths run through
    the costs in rising order, and within one cost all paths are equally short: a source takes tokens from patterns
    with room at that cost, or takes them over from another source that shares a pattern, which in turn takes others.
    A search visits sources, not patterns; one push moves what all patterns of a step have together. Its time grows
    with the arcs (pairs of a pattern and one of its sources) times the pushes, and these with the sources.
    """

    def __init__(self, arc_pattern: np.ndarray, arc_source: np.ndarray, capacity: np.ndarray, quota: np.ndarray, repeats: np.ndarray):
        self.p, self.x = arc_pattern, arc_source
        self.capacity, self.unmet, self.repeats = capacity, quota.copy(), repeats
        self.flow = np.zeros(len(arc_pattern), dtype=np.int64)
        self.limit = capacity[arc_pattern] * repeats[arc_source]
        self.used = np.zeros(len(capacity), dtype=np.int64)
        self.most = np.zeros(len(capacity), dtype=np.int64)
        np.maximum.at(self.most, arc_pattern, repeats[arc_source])
        self.arcs_of = [np.flatnonzero(arc_source == x) for x in range(len(quota))]

    def _path(self, room: np.ndarray) -> list[int] | None:
        """Sources from one that a pattern with room serves to one whose quota is not met."""
        free = self.flow < self.limit
        n = len(self.unmet)
        came = {int(x): -1 for x in np.flatnonzero(np.bincount(self.x[free & (room[self.p] > 0)], minlength=n))}
        queue = list(came)
        for x in queue:
            if self.unmet[x] > 0:
                path = [x]
                while came[path[-1]] >= 0:
                    path.append(came[path[-1]])
                return path[::-1]
            own = self.arcs_of[x]
            giving = np.zeros(len(self.capacity), dtype=bool)
            giving[self.p[own[self.flow[own] > 0]]] = True
            for y in np.flatnonzero(np.bincount(self.x[free & giving[self.p]], minlength=n)).tolist():
                if y not in came:
                    came[y] = x
                    queue.append(y)
        return None

    def _steps(self, room: np.ndarray, path: list[int]) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
        """(arcs that gain, arcs that lose, how much each can move) for each step of a path."""
        first = self.arcs_of[path[0]]
        steps = [(first, None, np.minimum(room[self.p[first]], self.limit[first] - self.flow[first]))]
        for x, y in zip(path, path[1:]):
            lose, gain = self.arcs_of[x], self.arcs_of[y]
            _, i, j = np.intersect1d(self.p[lose], self.p[gain], assume_unique=True, return_indices=True)
            lose, gain = lose[i], gain[j]
            steps.append((gain, lose, np.minimum(self.flow[lose], self.limit[gain] - self.flow[gain])))
        return steps

    def run(self) -> np.ndarray:
        """Tokens on each arc."""
        for k in range(int(self.most.max(initial=0))):
            while True:
                room = np.where(k < self.most, np.maximum(self.capacity * (k + 1) - self.used, 0), 0)
                path = self._path(room)
                if path is None:
                    break
                steps = self._steps(room, path)
                push = min(int(self.unmet[path[-1]]), *(int(c.sum()) for *_, c in steps))
                for gain, lose, c in steps:
                    move = np.clip(push - (np.cumsum(c) - c), 0, c)
                    self.flow[gain] += move
                    if lose is None:
                        self.used[self.p[gain]] += move
                    else:
                        self.flow[lose] -= move
                self.unmet[path[-1]] -= push
        return self.flow


def routed(capacity: dict[tuple[str, ...], int], quota: dict[str, int], repeats: dict[str, int]) -> dict[tuple[str, ...], dict[str, int]]:
    """Tokens that each membership pattern gives to each source: as much of every quota as can be met, repeating least.

    A token of a pattern may be used once at no cost, a second time at cost 1, a third at cost 2 and so on
    (convex), at most as often as the largest ``repeats`` of its sources, and by one source at most that
    source's ``repeats`` times.
    """
    patterns, sources = sorted(capacity), sorted(quota)
    number = {x: i for i, x in enumerate(sources)}
    arcs = [(i, number[x]) for i, p in enumerate(patterns) for x in p]
    arc_p, arc_x = (np.array(a, dtype=np.int64) for a in (zip(*arcs) if arcs else ((), ())))
    as_array = lambda values: np.array(values, dtype=np.int64)
    flow = PatternFlow(arc_p, arc_x, as_array([capacity[p] for p in patterns]), as_array([quota[x] for x in sources]), as_array([repeats[x] for x in sources])).run().tolist()
    out: dict[tuple[str, ...], dict[str, int]] = {p: {} for p in patterns}
    for (i, x), v in zip(arcs, flow):
        out[patterns[i]][sources[x]] = v
    return out


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): documents mixed so that each source makes up its target share of ``total_tokens``.

    Selection: source, doc_id, n_tokens, n_uses. Shares: source, target_share, target_tokens, available_tokens,
    actual_tokens, actual_share, most_uses, n_docs; ``actual_share`` is of the tokens really selected.

    Documents with the same text are one record that belongs to all their sources; no record is used more
    often than the largest ``max_repeats`` of its sources, nor by one source more than that source's. The
    total is that of all distinct records if not given. A source that can't reach its share gets all it may
    and the others keep their own targets. Texts that are null or without tokens, sources that are null or
    without target, and targets that are null or not positive take no part; of repeated targets the largest
    counts. Shares are met to within one document at either end of a source's stretch.

    Only sums per pattern reach the driver, which routes them (:class:`PatternFlow`). A pattern's documents are laid on a line in seeded order, as
    often as they are used, and the line is cut into its sources' stretches; offsets on the line come from
    sums of hash buckets and a running sum within each, so no task orders a whole pattern.
    """
    goals = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()
    share, repeats = {r["source"]: r["share"] for r in goals}, {r["source"]: r["repeats"] for r in goals}
    d = documents.where("doc_id is not null and text is not null and source is not null").where(F.col("source").isin(list(share)))
    sized = with_token_counts(d.select("doc_id", "source", "text"), tokenizer=tokenizer).where("n_tokens > 0").select("doc_id", "source", F.sha2("text", 256).alias("fp"), "n_tokens")
    each = sized.groupBy("fp", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    records = each.groupBy("fp").agg(F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("members"))
    records = written(records.withColumn("pattern", F.transform("members", lambda m: m["source"])).withColumn("h", F.xxhash64(F.lit(seed), "fp")))
    sums = records.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    rows = sums.collect()
    capacity = {tuple(r["pattern"]): int(r["tokens"]) for r in rows}
    total = sum(capacity.values()) if total_tokens is None else total_tokens
    quota = {x: round(v * total) for x, v in share.items()}
    flow = routed(capacity, quota, repeats)

    spark = documents.sparkSession
    plan = []
    for r in rows:
        p = tuple(r["pattern"])
        at, stretches = 0, []
        for x in p:
            stretches.append((x, at, at + flow[p][x]))
            at += flow[p][x]
        plan.append((list(p), capacity[p], at, max(1, int(r["n"]) // BUCKET_ROWS + 1), stretches))
    plan_df = spark.createDataFrame(plan, "pattern array<string>, capacity long, length long, buckets int, stretches array<struct<source:string,a:long,b:long>>")
    plan_df = broadcast_if_small(plan_df, sum(len(r["pattern"]) + 1 for r in rows), _PLAN_BYTES)
    laid = records.join(plan_df, "pattern").where("length > 0").withColumn("bucket", F.pmod("h", F.col("buckets")))
    base = laid.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("pattern", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("h", "fp").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, ["pattern", "bucket"])
    laid = laid.withColumn("c", F.col("base") + F.col("within"))
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / F.col("capacity")))
    spots = F.transform(turns, lambda j: j * F.col("capacity") + F.col("c"))
    uses = F.transform("stretches", lambda s: F.struct(s["source"].alias("source"), F.size(F.filter(spots, lambda x: (x >= s["a"]) & (x < s["b"]))).alias("n_uses")))
    named = laid.select("n_tokens", "members", F.explode(F.filter(uses, lambda u: u["n_uses"] > 0)).alias("u"))
    doc = F.get(F.filter("members", lambda m: m["source"] == F.col("u.source")), F.lit(0))["doc_id"]
    selection = written(named.select(F.col("u.source").alias("source"), doc.alias("doc_id"), "n_tokens", F.col("u.n_uses").alias("n_uses")))

    have = records.select("n_tokens", F.explode("pattern").alias("source")).groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    got = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("actual_tokens"), F.max("n_uses").alias("most_uses"), F.count(F.lit(1)).alias("n_docs"))
    wanted = spark.createDataFrame([(x, float(share[x]), int(quota[x])) for x in sorted(share)], "source string, target_share double, target_tokens long")
    shares = wanted.join(have, "source", "left").join(got, "source", "left").fillna(0)
    all_tokens = Window.partitionBy()
    shares = shares.withColumn("actual_share", F.coalesce(F.col("actual_tokens") / F.nullif(F.sum("actual_tokens").over(all_tokens), F.lit(0)), F.lit(0.0)))
    return selection, shares.select("source", "target_share", "target_tokens", "available_tokens", "actual_tokens", "actual_share", "most_uses", "n_docs")
