"""Queries on match graphs and training text, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table, written
from . import canonical, components, content, leakage, mixing


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.consolidate(table(spark, d, "matches"), table(spark, d, "ground_control_points"))


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups of each kind have each size."""
    groups = p3_found(spark, d).groupBy("kind", "group_key").agg(F.count(F.lit(1)).alias("n_records"))
    return groups.groupBy("kind", "n_records").agg(F.count(F.lit(1)).alias("n_groups"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.mapped_entries(table(spark, d, "exif"), table(spark, d, "camera_models"))


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    exif = table(spark, d, "exif")
    return canonical.unmatched_report(exif, canonical.mapped_entries(exif, table(spark, d, "camera_models")))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(_leaks(spark, d))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents that stay, by source."""
    left = leakage.without_leaks(table(spark, d, "documents").select("doc_id", "source"), written(p8_found(spark, d)))
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return content.scored_documents(table(spark, d, "documents"), table(spark, d, "content_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where("flagged").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return content.rates(_scores(spark, d))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_sizes, p6_found, p6_unmatched, p8_found, p8_items, p8_clean, p9_shares, p9_selection, p10_found, p10_scores, p10_rates)
}

_P3 = """
with recursive
ok as (select im1 || '#' || f1 a, im2 || '#' || f2 b from matches where im1 is not null and im2 is not null and f1 >= 0 and f2 >= 0),
refs as (
  select p, nullif(lower(regexp_replace(o.shot_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), '') s
  from (select coalesce('i' || id, 'r' || row_number() over ()) p, unnest(observations) o from ground_control_points)),
links as (
  select distinct 'feature' kind, a, b from ok
  union select distinct 'shot', min(s) over (partition by p), s from refs where s is not null),
edges as (select kind, a, b from links union select kind, b, a from links),
reach as (
  select kind, a record_key, b other from edges union select kind, a, a from edges
  union select r.kind, r.record_key, e.b from reach r join edges e on e.kind = r.kind and e.a = r.other)
select kind, record_key, min(other) group_key from reach group by 1, 2
"""

_WORDS = r"list_filter(regexp_split_to_array(lower(nfc_normalize({})), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: x <> '')"

_P8 = f"""
with d as (select doc_id, {_WORDS.format("text")} w from documents where text is not null),
e as (select item_id, {_WORDS.format("text")} w from eval_items where text is not null),
dg as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g from d where len(w) >= 12),
eg as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g from e where len(w) >= 12)
select distinct doc_id, item_id from dg join eg using (g)
"""

# runs of shared grams along one diagonal of document and item
_P8_ITEMS = f"""
with d as (select doc_id, {_WORDS.format("text")} w from documents where text is not null),
e as (select item_id, {_WORDS.format("text")} w from eval_items where text is not null),
dg as (select doc_id, unnest(range(1, len(w) - 10)) i, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g from d where len(w) >= 12),
eg as (select item_id, unnest(range(1, len(w) - 10)) j, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g from e where len(w) >= 12),
m as (select distinct doc_id, item_id, i, i - j k from dg join eg using (g)),
r as (select *, i - row_number() over (partition by doc_id, item_id, k order by i) run from m),
l as (select doc_id, item_id, count(*) + 11 n from r group by doc_id, item_id, k, run)
select item_id, count(distinct doc_id) n_docs, max(n)::int longest from l group by 1
"""

ORACLE = {
    "p8_items": _P8_ITEMS,
    "p3_found": _P3,
    "p3_sizes": f"select kind, n_records, count(*) n_groups from (select kind, group_key, count(*) n_records from ({_P3}) group by 1, 2) group by 1, 2",
    "p8_found": _P8,
    "p8_clean": f"select source, count(*) n_docs from documents where doc_id not in (select doc_id from ({_P8})) group by 1",
}
