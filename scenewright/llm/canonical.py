"""Freely entered make and model names to the entries of a canonical list, by BK-trees under a true edit metric."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written

# Letters that look like Latin ones, words of company names, and texts that say nothing.
LOOKALIKES = str.maketrans(
    "аеорсухкмнтвіјѕԁһԛԝьАЕОРСУХКМНТВІЈЅαοερικνυΑΟΕΡΙΚΝΥΤΗΜΒΧ",
    "aeopcyxkmhtbijsdhqwbAEOPCYXKMHTBIJSaoepiknuAOEPIKNYTHMBX",
)
COMPANY = {"inc", "gmbh", "corp", "corporation", "co", "ltd", "limited", "imaging", "llc", "ag", "kg", "sa", "plc", "company"}
NOISE = {"camera", "cam", "tm", "r", "digital"}
NOTHING = {"", "unknown", "n/a", "na", "none", "null", "-"}

#: Edits allowed in the whole of an entry; a word takes 0 up to 3 letters, 1 up to 5, 2 beyond.
THRESHOLD = 4
#: Entries of the canonical list in one broadcast shard.
SHARD_ENTRIES = 20_000
#: Stored pairs that one task looks up.
TASK_PAIRS = 2_000

_VERSION = re.compile(r"\b(?:fw|firmware|ver|version)\.?\s*\d+(?:\.\d+)*\b|\bv\s?\d+(?:\.\d+)+\b")
_MARKS = re.compile(r"\((?:tm|r|c)\)|[®©™]")
_TOKEN = re.compile(r"\d+(?:[a-z](?![a-z]))?|[^\W\d_]+")
_ZERO = re.compile(r"(?<=\d)o|o(?=\d)")
_ONE = re.compile(r"(?<=\d)[il](?![a-z])")


def tokens(text: str | None) -> list[str]:
    """Words and numbers of a name: compatibility forms, look-alikes and case folded, marks and versions dropped."""
    if text is None:
        return []
    t = unicodedata.normalize("NFKC", _MARKS.sub(" ", text)).translate(LOOKALIKES).lower()
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    t = _VERSION.sub(" ", _MARKS.sub(" ", t))
    while (z := _ONE.sub("1", _ZERO.sub("0", t))) != t:
        t = z
    return [w for w in _TOKEN.findall(t) if w not in NOISE]


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance, which keeps the triangle inequality."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            i1, j1 = last.get(b[j - 1], 0), seen
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, seen = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[a[i - 1]] = i
    return d[-1][-1]


Name = tuple[str, str, str]  # make, letters of the model, numbers of the model


def name_of(make: list[str], model: list[str]) -> Name:
    return ("".join(w for w in make if w not in COMPANY), "".join(w for w in model if not w[0].isdigit() and w not in COMPANY), " ".join(w for w in model if w[0].isdigit()))


class BKTree:
    """Entries under ``metric``; children of a node by their distance to it."""

    #: Distance between names whose numbers differ: numbers are no spelling.
    NUMBERS = 50

    def __init__(self, with_make: bool):
        self.with_make = with_make
        self.cache: dict[tuple[str, str], int] = {}
        self.root: list | None = None

    def word(self, a: str, b: str) -> int:
        if a == b:
            return 0
        k = (a, b)
        d = self.cache.get(k)
        if d is None:
            if len(self.cache) > 2_000_000:
                self.cache.clear()
            d = self.cache[k] = damerau(a, b)
        return d

    def metric(self, a: Name, b: Name) -> int:
        """A sum of metrics: edits of the make, edits of the model's letters, and whether the numbers differ."""
        d = self.word(a[1], b[1]) + (self.NUMBERS if a[2] != b[2] else 0)
        return d + self.word(a[0], b[0]) if self.with_make else d

    def add(self, name: Name, entry: int) -> None:
        if self.root is None:
            self.root = [name, [entry], {}]
            return
        node = self.root
        while True:
            d = self.metric(name, node[0])
            if d == 0 and (self.with_make or name[1:] == node[0][1:]):
                node[1].append(entry)
                return
            if d not in node[2]:
                node[2][d] = [name, [entry], {}]
                return
            node = node[2][d]

    def within(self, name: Name, radius: int) -> list[tuple[int, Name, list[int]]]:
        """Every entry at most ``radius`` away: subtrees that the triangle inequality rules out are skipped."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = self.metric(name, node[0])
            if d <= radius:
                out.append((d, node[0], node[1]))
            for e, child in node[2].items():
                if d - radius <= e <= d + radius:
                    stack.append(child)
        return out


def _allowed(word: str) -> int:
    return 0 if len(word) <= 3 else 1 if len(word) <= 5 else 2


class Matcher:
    """The best entries of one shard of the list for a stored make and model."""

    def __init__(self, entries: list[tuple[int, str, str]]):
        self.full, self.model = BKTree(True), BKTree(False)
        for entry, make, model in sorted(entries):
            name = name_of(tokens(make), tokens(model))
            self.full.add(name, entry)
            self.model.add(name, entry)
        self.memo: dict[tuple, tuple[int, list[int]]] = {}

    def search(self, name: Name, with_make: bool) -> tuple[int, list[int]]:
        key = (name, with_make)
        got = self.memo.get(key)
        if got is None:
            tree = self.full if with_make else self.model
            best: tuple[int, list[int]] = (THRESHOLD + 1, [])
            for d, entry, ids in tree.within(name, THRESHOLD):
                if tree.word(name[1], entry[1]) > _allowed(entry[1]) or with_make and tree.word(name[0], entry[0]) > _allowed(entry[0]):
                    continue
                if d < best[0]:
                    best = (d, list(ids))
                elif d == best[0]:
                    best = (d, best[1] + ids)
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[key] = best
        return got

    def find(self, make: str | None, model: str | None) -> tuple[int, list[int]]:
        """(distance, entries at it): over the readings of the two fields as make and model, swapped, or one holding both."""
        a, b = tokens(make), tokens(model)
        silent = lambda t: t is None or t.strip().lower() in NOTHING
        readings = []
        if silent(make):
            a = []
        if silent(model):
            b = []
        if a and b:
            readings += [(a, b), (b, a)]
        for one in (b, a):
            readings += [(one[:k], one[k:]) for k in range(1, len(one))]
        best: tuple[int, list[int]] = (THRESHOLD + 1, [])
        for x, y in readings:
            found = self.search(name_of(x, y), True)
            if found[0] < best[0]:
                best = found
        for own, other in ((b, a), (a, b)):
            if own and not other:
                found = self.search(name_of([], own), False)
                if found[0] < best[0]:
                    best = found
        return best[0], sorted(set(best[1]))


def mapped_entries(records: DataFrame, entries: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """shot_id, model_id: the entry that each stored (make, model) means, 0 where no single entry is meant.

    Records whose pair is an entry letter for letter, and those whose two fields are null, empty or
    ``unknown``, have no row. A name means the entry with the fewest edits (true Damerau-Levenshtein over
    letters; numbers must agree) within the thresholds; when entries tie, or none comes near, it means none.
    Missing makes leave the choice to the model alone. Repeated records come out once; null shots are left
    out; an empty list of entries maps all to 0.

    Distinct pairs are mapped, not records. The list is broadcast in shards of at most ``shard_entries``
    entries; the winners of the shards are merged by distance.
    """
    entries = entries.select("model_id", "make", "model").where("model_id is not null and model is not null").distinct()
    said = lambda c: ~F.coalesce(F.lower(F.trim(c)), F.lit("")).isin("", "unknown")
    rows = records.where("shot_id is not null").select("shot_id", "make", "model").distinct().where(said("make") | said("model"))
    listed = entries.select("make", "model").distinct().withColumn("_listed", F.lit(True))
    pairs = written(rows.select("make", "model").distinct().join(listed, ["make", "model"], "left").where("_listed is null").select("make", "model"))
    pairs = pairs.repartition(pairs.count() // TASK_PAIRS + 1)  # few bytes, much work: sizes alone would put them into one task
    total = entries.count()
    shards = max(1, -(-total // shard_entries))
    found = None
    for k in range(shards):
        part = [tuple(r) for r in entries.where(F.pmod(F.xxhash64("model_id"), F.lit(shards)) == k).toLocalIterator()]
        sent = records.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            matcher = Matcher([(i, make or "", model) for i, make, model in sent.value])
            for b in batches:
                got = [matcher.find(None if pd.isna(x) else x, None if pd.isna(y) else y) for x, y in zip(b["make"], b["model"])]
                yield pd.DataFrame({"make": b["make"], "model": b["model"], "d": [g[0] for g in got], "ids": [g[1][:2] for g in got]})

        one = pairs.mapInPandas(run, "make string, model string, d int, ids array<int>")
        found = one if found is None else found.unionByName(one)
    if shards > 1:
        least = found.groupBy("make", "model").agg(F.min("d").alias("least"))
        same = (F.col("f.make").eqNullSafe(F.col("l.make"))) & (F.col("f.model").eqNullSafe(F.col("l.model"))) & (F.col("f.d") == F.col("l.least"))
        found = found.alias("f").join(least.alias("l"), same).select("f.make", "f.model", "f.ids").groupBy("make", "model").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    meant = found.select("make", "model", F.when(F.size("ids") == 1, F.get("ids", F.lit(0))).otherwise(0).alias("model_id"))
    m, r = meant.alias("m"), rows.alias("r")
    return r.join(m, F.col("r.make").eqNullSafe(F.col("m.make")) & F.col("r.model").eqNullSafe(F.col("m.model"))).select("shot_id", "model_id").distinct()


def unmatched_report(records: DataFrame, mapped: DataFrame) -> DataFrame:
    """Stored names that mean no listed entry, with the number of records of each."""
    none = mapped.where("model_id = 0").select("shot_id")
    return records.select("shot_id", "make", "model").distinct().join(none, "shot_id").groupBy("make", "model").agg(F.count(F.lit(1)).alias("n_records"))
