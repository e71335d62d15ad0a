"""Queries p1, p2, p4, p5 and p7 over the scene tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orphans, proximity, spikes, timestamps, units
from ..runtime import table, written


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, d, "shot_measurements"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(table(spark, d, "images"), table(spark, d, "cameras"), table(spark, d, "ground_control_points"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p2_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.capture_instants(table(spark, d, "shot_measurements"), table(spark, d, "image_groups"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.shots_near_control_points(table(spark, d, "ground_control_points"), table(spark, d, "shot_measurements"), table(spark, d, "image_groups"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Shots near each control point that has any."""
    return p5_found(spark, d).groupBy("gcp_id").agg(F.count(F.lit(1)).alias("n_shots"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(table(spark, d, "exif"), table(spark, d, "exif_writers"))


def p7_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Per writer the values for which more than one combination of units fits equally well."""
    return units.ambiguity_report(written(units.resolved_units(table(spark, d, "exif"), table(spark, d, "exif_writers"))))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_report, p4_found, p5_found, p5_counts, p7_found, p7_ambiguous)}

_CLEAN = r"nullif(lower(regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"

_P2 = rf"""
with img as (select shot_id record_key, min(ingested_at) t0 from images where shot_id is not null group by 1),
gcp as (select id record_key, min(ingested_at) t0 from ground_control_points where id is not null group by 1),
refs as (
  select distinct 'images' table_name, i.record_key, {_CLEAN.format("m.camera_id")} ref_key, i.t0
  from images m join img i on m.shot_id = i.record_key
  union
  select distinct 'ground_control_points', g.record_key, {_CLEAN.format("o.o.shot_id")}, g.t0
  from (select id, unnest(observations) o from ground_control_points) o join gcp g on o.id = g.record_key),
lives as (
  select 'images' table_name, {_CLEAN.format("camera_id")} ref_key, created_at s, deleted_at e from cameras
  union all
  select 'ground_control_points', {_CLEAN.format("shot_id")}, min(ingested_at), case when count(deleted_at) = count(*) then max(deleted_at) end
  from images where shot_id is not null group by shot_id),
judged as (
  select r.table_name, r.record_key, r.ref_key, r.t0,
    count(l.ref_key) n,
    count(*) filter (where l.ref_key is not null and (l.s is null or l.s <= r.t0) and (l.e is null or l.e > r.t0)) n_live,
    count(*) filter (where l.ref_key is not null and l.s > r.t0) n_late
  from refs r left join lives l on l.table_name = r.table_name and l.ref_key = r.ref_key
  where r.ref_key is not null group by all)
select table_name, record_key, ref_key,
  case when n = 0 then 'missing' when n_late = n then 'late' else 'deleted' end ref_state,
  strftime(t0, '%Y-%m') ref_month
from judged where n = 0 or (n_live = 0 and t0 is not null)
"""

_P5 = """
with g as (select distinct id, position.latitude lat, position.longitude lon from ground_control_points where position.latitude is not null and position.longitude is not null),
r as (select distinct sequence_key, radians(reference_lla.latitude) la, radians(reference_lla.longitude) lo, coalesce(reference_lla.altitude, 0.0) h from image_groups),
s as (
  select distinct m.shot_id, gps_position[1] e, gps_position[2] n, gps_position[3] u, la, lo, h,
    6378137.0 / sqrt(1 - (1 - pow(6356752.314245 / 6378137.0, 2)) * pow(sin(la), 2)) nn
  from shot_measurements m join r using (sequence_key)
  where abs(gps_position[1]) <= 5000 and abs(gps_position[2]) <= 5000 and abs(gps_position[3]) <= 5000),
x as (
  select shot_id,
    (nn + h) * cos(la) * cos(lo) - sin(lo) * e - sin(la) * cos(lo) * n + cos(la) * cos(lo) * u x,
    (nn + h) * cos(la) * sin(lo) + cos(lo) * e - sin(la) * sin(lo) * n + cos(la) * sin(lo) * u y,
    (nn * pow(6356752.314245 / 6378137.0, 2) + h) * sin(la) + cos(la) * n + sin(la) * u z from s),
b as (select shot_id, x, y, z, sqrt(x * x + y * y) p, atan2(z * 6378137.0, sqrt(x * x + y * y) * 6356752.314245) t from x),
l as (
  select shot_id, atan2(y, x) lo,
    atan2(z + (pow(6378137.0 / 6356752.314245, 2) - 1) * 6356752.314245 * pow(sin(t), 3),
          p - (1 - pow(6356752.314245 / 6378137.0, 2)) * 6378137.0 * pow(cos(t), 3)) la from b),
f as (
  select 0 side, id, radians(lat) la, radians(lon) lo from g union all select 1, shot_id, la, lo from l),
c as (
  select side, id, 6378137.0 / sqrt(1 - (1 - pow(6356752.314245 / 6378137.0, 2)) * pow(sin(la), 2)) nn, la, lo from f),
k as (
  select side, id, nn * cos(la) * cos(lo) x, nn * cos(la) * sin(lo) y, nn * pow(6356752.314245 / 6378137.0, 2) * sin(la) z from c)
select distinct a.id gcp_id, b.id shot_id
from (select *, floor(z / 100.0) zb from k where side = 0) a
join (select *, floor(z / 100.0) zb from k where side = 1) b on b.zb between a.zb - 1 and a.zb + 1
where pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 900.0
"""

ORACLE = {
    "p2_found": _P2,
    "p2_report": f"select table_name, ref_month, ref_state, count(*) n_refs, count(distinct record_key) n_records from ({_P2}) group by 1, 2, 3",
    "p5_found": _P5,
    "p5_counts": f"select gcp_id, count(*) n_shots from ({_P5}) group by 1",
}
