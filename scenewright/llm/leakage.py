"""Evaluation passages inside training text: suffix arrays over shards of the corpus, searched for every test suffix."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that must be shared in a row; words of corpus in one suffix array; test items searched at once.
MIN_WORDS = 12
SHARD_WORDS = 400_000
ITEM_BLOCK = 20_000

_WORD = re.compile(r"[^\W_]+")
_JOINERS = re.compile("[­​-‏⁠﻿]")


def words(text: str | None) -> list[str]:
    """Words of a text: compatibility forms composed, case folded, punctuation and invisible signs dropped."""
    if not text:
        return []
    t = unicodedata.normalize("NFKC", _JOINERS.sub("", text)).casefold()
    return _WORD.findall(unicodedata.normalize("NFKC", t))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` (integers >= 0) in order of their first ``depth`` words, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth and n > 1:
        second = np.zeros(n, dtype=np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == n - 1:
            break
    return order


def _common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Words that a[i:] and b[j:] have in common at their start, at most ``limit``; both end in a sign of their own."""
    length = np.zeros(len(i), dtype=np.int64)
    live = np.arange(len(i))
    for t in range(limit):
        live = live[a[i[live] + t] == b[j[live] + t]]
        if not len(live):
            break
        length[live] = t + 1
    return length


def _bound(text: np.ndarray, order: np.ndarray, query: np.ndarray, starts: np.ndarray, width: int, right: bool) -> np.ndarray:
    """Binary search of every query suffix, by its first ``width`` words, in the suffix array at once."""
    lo, hi = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), len(order), dtype=np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        at = order[mid]
        same = _common(text, at, query, starts[open_], width)
        rest = same < width
        less = np.zeros(len(open_), dtype=bool)
        less[rest] = text[at[rest] + same[rest]] < query[starts[open_][rest] + same[rest]]
        go = less | (~rest if right else False)
        lo[open_] = np.where(go, mid + 1, lo[open_])
        hi[open_] = np.where(go, hi[open_], mid)
    return lo


def search_shard(docs: list[tuple[int, list[str]]], items: list[tuple[int, list[str]]], least: int) -> pd.DataFrame:
    """doc_id, item_id, n_words, doc_word, item_word: the longest match of each pair that shares ``least`` words or more."""
    columns = ["doc_id", "item_id", "n_words", "doc_word", "item_word"]
    vocabulary: dict[str, int] = {}
    items = [(i, w) for i, w in items if len(w) >= least]
    docs = [(d, w) for d, w in docs if len(w) >= least]
    if not items or not docs:
        return pd.DataFrame(columns=columns)
    for _, w in items:
        for x in w:
            vocabulary.setdefault(x, len(vocabulary) + 3)
    deepest = max(len(w) for _, w in items)
    # 0 pads the end, 1 ends a test item, 2 stands for words that no test item has and ends a document
    pad = np.zeros(deepest + 1, dtype=np.int64)
    text = np.concatenate([*(np.array([*(vocabulary.get(x, 2) for x in w), 2], dtype=np.int64) for _, w in docs), pad])
    query = np.concatenate([*(np.array([*(vocabulary[x] for x in w), 1], dtype=np.int64) for _, w in items), pad])
    d_len, i_len = np.array([len(w) + 1 for _, w in docs]), np.array([len(w) + 1 for _, w in items])
    d_of, i_of = np.repeat(np.arange(len(docs)), d_len), np.repeat(np.arange(len(items)), i_len)
    d_start, i_start = np.cumsum(d_len) - d_len, np.cumsum(i_len) - i_len
    order = suffix_array(text, deepest)
    starts = np.flatnonzero(np.arange(len(i_of)) - i_start[i_of] <= i_len[i_of] - 1 - least)
    left, right = (_bound(text, order, query, starts, least, side) for side in (False, True))
    hit = np.flatnonzero(right > left)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for q in hit:
        at = order[left[q] : right[q]]
        s = np.full(len(at), starts[q])
        n = _common(text, at, query, s, deepest)
        item = int(i_of[starts[q]])
        for d, a, k in zip(d_of[at].tolist(), at.tolist(), n.tolist()):
            old = best.get((d, item))
            if old is None or k > old[0]:
                best[d, item] = (k, a - int(d_start[d]), int(starts[q] - i_start[item]))
    rows = [(docs[d][0], items[i][0], k, a, b) for (d, i), (k, a, b) in best.items()]
    return pd.DataFrame(rows, columns=columns)


def leaks(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS, shard_words: int = SHARD_WORDS, item_block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, n_words, doc_word, item_word: documents that share ``least`` words in a row with a test item.

    ``n_words`` is the longest passage shared, ``doc_word`` and ``item_word`` where it starts. Each task
    cuts its own part of the corpus into shards of about ``shard_words`` words (a longer document is a
    shard of its own), builds the suffix array of each and searches all test suffixes in it; nothing is
    shuffled. Test items are broadcast in blocks of at most ``item_block``. Null texts and ids and texts
    below ``least`` words have no matches; repeated rows come out once; empty tables give no rows.
    """
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    items = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    blocks = max(1, -(-items.count() // item_block))
    out = None
    for k in range(blocks):
        block = [(r["item_id"], words(r["text"])) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toLocalIterator()]
        sent = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            shard, size = [], 0
            for b in batches:
                for d, t in zip(b["doc_id"].tolist(), b["text"].tolist()):
                    w = words(t)
                    shard.append((d, w))
                    size += len(w) + 1
                    if size >= shard_words:
                        yield search_shard(shard, sent.value, least)
                        shard, size = [], 0
            if shard:
                yield search_shard(shard, sent.value, least)

        found = docs.mapInPandas(run, "doc_id bigint, item_id bigint, n_words int, doc_word int, item_word int")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that no test item leaked into, null ids included."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def leak_report(found: DataFrame) -> DataFrame:
    """Per test item: documents it leaked into and the longest passage."""
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))
