"""Queries for the operators on scenes, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exif as fx
from ..functions import geo
from ..operators import graph, observations, retrieval, statistics, timeline
from ..operators import proximity
from ..runtime import checkpointed, ranked, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return observations.distinct_observations(table(spark, d, "observations"))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """Shots with possible positions, repeated deliveries once."""
    p = table(spark, d, "shot_measurements").select("sequence_key", "shot_id", *(F.get("gps_position", F.lit(i)).alias(a) for i, a in enumerate("enu")), "gps_accuracy").distinct()
    return p.where("shot_id is not null and abs(e) <= 5000 and abs(n) <= 5000 and abs(u) <= 5000")


_OBS = "(select distinct * from observations where shot_id is not null and track_id is not null and feature_id is not null)"
_GOOD = f"(select track_id, count(*) length from {_OBS} group by 1 having count(*) >= 2 and count(*) = count(distinct shot_id))"
_GOBS = f"(select o.* from {_OBS} o semi join {_GOOD} g on o.track_id = g.track_id)"
_POS = """(select distinct sequence_key, shot_id, gps_position[1] e, gps_position[2] n, gps_position[3] u, gps_accuracy from shot_measurements
  where shot_id is not null and abs(gps_position[1]) <= 5000 and abs(gps_position[2]) <= 5000 and abs(gps_position[3]) <= 5000)"""
_PAIRS = f"(select a.shot_id im1, b.shot_id im2, count(*) n_common from {_GOBS} a join {_GOBS} b on a.track_id = b.track_id and a.shot_id < b.shot_id group by 1, 2)"


@query(f"select * from {_PAIRS}")
def covisibility_pairs(spark, d):
    return observations.covisibility(_obs(spark, d))


@query(f"select track_id, length from {_GOOD}")
def good_tracks(spark, d):
    return observations.good_tracks(_obs(spark, d))


@query(f"""select a.shot_id im1, b.shot_id im2, list_sort(list(a.track_id)) tracks from {_GOBS} a join {_GOBS} b
  on a.track_id = b.track_id and a.shot_id < b.shot_id group by 1, 2 having count(*) >= 5""")
def common_tracks_min(spark, d):
    return observations.common_tracks(_obs(spark, d), 5)


@query(f"select length, count(*) n_tracks from {_GOOD} group by 1")
def track_length_histogram(spark, d):
    return observations.good_tracks(_obs(spark, d)).groupBy("length").agg(F.count(F.lit(1)).alias("n_tracks"))


@query(f"""select count(*) n_tracks, sum(length)::bigint n_observations, round(avg(length), 6) average_length,
  round(avg(length) filter (where length > 2), 6) average_length_over_two from {_GOOD}""")
def reconstruction_summary(spark, d):
    g = observations.good_tracks(_obs(spark, d))
    over = F.avg(F.when(F.col("length") > 2, F.col("length")))
    return g.agg(F.count(F.lit(1)).alias("n_tracks"), F.sum("length").alias("n_observations"), F.round(F.avg("length"), 6).alias("average_length"), F.round(over, 6).alias("average_length_over_two"))


@query(f"""select shot_id, coalesce(n, 0) n_points from (select distinct shot_id from images where shot_id is not null)
  left join (select shot_id, count(distinct track_id) n from {_GOBS} group by 1) using (shot_id)""")
def visible_points_per_shot(spark, d):
    obs = _obs(spark, d)
    return observations.visible_points(table(spark, d, "images"), obs, observations.good_tracks(obs))


@query(f"""select o.* from {_OBS} o semi join {_GOOD} g on o.track_id = g.track_id
  semi join (select shot_id from images where deleted_at is null) i on i.shot_id = o.shot_id""")
def sub_tracks(spark, d):
    obs = _obs(spark, d)
    return observations.sub_tracks(obs, observations.good_tracks(obs), table(spark, d, "images").where("deleted_at is null")).select(*obs.columns)


@query(f"""select o.* from {_OBS} o semi join (select track_id from {_OBS} group by 1 having count(*) >= 5) k on o.track_id = k.track_id""")
def min_observation_tracks(spark, d):
    obs = _obs(spark, d)
    return observations.min_observations(obs, 5).select(*obs.columns)


@query(f"""with m as (select *, x * x + y * y > 0.25 bad from {_GOBS}),
  s as (select track_id from m group by 1 having count(*) filter (where bad) = 0 or count(*) filter (where not bad) >= 2)
  select shot_id, track_id, feature_id from m semi join s on m.track_id = s.track_id where not bad""")
def remove_outliers(spark, d):
    obs = observations.in_good_tracks(_obs(spark, d))
    return observations.remove_outliers(obs, F.col("x") * F.col("x") + F.col("y") * F.col("y"), 0.5).select("shot_id", "track_id", "feature_id")


@query(f"""select track_id, median(r)::double median_r, median(g)::double median_g, median(b)::double median_b,
  arg_min(r, (shot_id, feature_id)) first_r, arg_min(g, (shot_id, feature_id)) first_g, arg_min(b, (shot_id, feature_id)) first_b
  from {_GOBS} group by 1 having count(*) >= 2""")
def track_colours(spark, d):
    return observations.track_colours(observations.in_good_tracks(_obs(spark, d)))


@query(f"""select bx, by_, count(*) n, round(sum(sqrt(x * x + y * y)) / (count(*) + 1), 6) mean_error from (
  select *, least(greatest(floor((x + 0.5) * 40), 0), 39)::int bx, least(greatest(floor((y + 0.5) * 40), 0), 39)::int by_ from {_OBS}) group by 1, 2""")
def residual_grid(spark, d):
    bx, by = statistics.grid_cells(F.col("x"), F.col("y"), 40, 40, 1.0, 1.0)
    e = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return _obs(spark, d).groupBy(bx.alias("bx"), by.alias("by_")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(e) / (F.count(F.lit(1)) + 1), 6).alias("mean_error"))


@query(f"""select min(n) min_features, max(n) max_features, floor(avg(n))::bigint mean_features, floor(median(n))::bigint median_features
  from (select shot_id, count(distinct feature_id) n from {_OBS} group by 1)""")
def features_statistics(spark, d):
    g = _obs(spark, d).groupBy("shot_id").agg(F.count_distinct("feature_id").alias("n"))
    return g.agg(F.min("n").alias("min_features"), F.max("n").alias("max_features"), F.floor(F.avg("n")).alias("mean_features"), F.floor(F.percentile("n", 0.5)).alias("median_features"))


@query(f"""with p as {_PAIRS}, q as (select quantile_cont(n_common, 0.05) lo, quantile_cont(n_common, 0.95) hi from p)
  select im1, im2, n_common, round(case when hi > lo then least(greatest(1 - (n_common - lo) / (hi - lo), 0), 1) else 0 end, 6) colour from p, q where n_common >= 2""")
def match_graph(spark, d):
    p = observations.covisibility(_obs(spark, d))
    q = p.agg(F.percentile("n_common", 0.05).alias("lo"), F.percentile("n_common", 0.95).alias("hi"))
    colour = F.when(F.col("hi") > F.col("lo"), F.least(F.greatest(1 - (F.col("n_common") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return p.join(F.broadcast(q)).where("n_common >= 2").select("im1", "im2", "n_common", F.round(colour, 6).alias("colour"))


_NODES = "(select distinct im1, f1, im2, f2 from matches where im1 is not null and im2 is not null and f1 >= 0 and f2 >= 0)"
_MTRACKS = f"""
with recursive m as {_NODES},
edges as (select (im1, f1) a, (im2, f2) b from m union select (im2, f2), (im1, f1) from m),
reach as (select a, a b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
lab as (select a, min(b) l from reach group by 1),
obs as (select a[1] shot_id, a[2] feature_id, l[1] || '#' || l[2] track_id from lab),
good as (select track_id from obs group by 1 having count(*) >= 2 and count(*) = count(distinct shot_id)),
mt as (select * from obs semi join good on obs.track_id = good.track_id)
"""


@query(f"{_MTRACKS} select * from mt")
def tracks_connected_components(spark, d):
    return graph.tracks_from_matches(table(spark, d, "matches"))


@query(f"{_MTRACKS} select distinct o.track_id track1, mt.track_id track2 from {_GOBS} o join mt on o.shot_id = mt.shot_id and o.feature_id = mt.feature_id")
def corresponding_tracks(spark, d):
    return observations.corresponding_tracks(observations.in_good_tracks(_obs(spark, d)), graph.tracks_from_matches(table(spark, d, "matches")))


@query(f"""{_MTRACKS},
  al as (select shot_id, feature_id, 'a:' || track_id t from {_GOBS} union select shot_id, feature_id, 'b:' || track_id from mt),
  li as (select distinct x.t u, y.t v from al x join al y on x.shot_id = y.shot_id and x.feature_id = y.feature_id),
  rr as (select u, u v from li union select r.u, l.v from rr r join li l on r.v = l.u)
  select u[1] name, u[3:] track_id, min(v) merged_id from rr group by u""")
def merge_tracks(spark, d):
    return graph.merge_tracks({"a": observations.in_good_tracks(_obs(spark, d)), "b": graph.tracks_from_matches(table(spark, d, "matches"))})


@query(f"""with p as {_PAIRS}, b as (select im1, im2, n_common n from p where n_common >= 2 union all select im2, im1, n_common from p where n_common >= 2),
  c as (select im1 shot_id from p group by 1 order by count(*) desc, 1 limit 1),
  r1 as (select im2 shot_id, sum(n) n from b where im1 in (from c) and im2 not in (from c) group by 1 order by 2 desc, 1 limit 39),
  i1 as (select shot_id, 0 ring from c union all select shot_id, 1 from r1),
  n2 as (select im2 shot_id, sum(n) n from b where im1 in (select shot_id from i1) and im2 not in (select shot_id from i1) group by 1),
  r2 as (select shot_id, n from n2 order by n desc, shot_id limit (select 40 - count(*) from i1)),
  i2 as (from i1 union all select shot_id, 2 from r2),
  r3 as (select distinct im2 shot_id from b where (select count(*) < 40 from i1) and im1 in (select shot_id from i2) and im2 not in (select shot_id from i2))
  select shot_id, ring::int ring from (from i2 union all select shot_id, 3 from r3 union all select shot_id, 3 from n2 where (select count(*) = 40 from i1))""")
def shot_neighborhood(spark, d):
    pairs = checkpointed(observations.covisibility(_obs(spark, d)))
    centre = pairs.groupBy("im1").count().orderBy(F.desc("count"), "im1").first()
    return graph.shot_neighbourhood(pairs, centre["im1"] if centre else "", 3, 2, 40)


@query("""select least(im1, im2) im1, greatest(im1, im2) im2, count(*) n_matches from (
  select distinct least((im1, f1), (im2, f2)) a, greatest((im1, f1), (im2, f2)) b, im1, im2 from (select distinct * from matches)
  where im1 is not null and im2 is not null and f1 >= 0 and f2 >= 0 and im1 <> im2 ) group by 1, 2 having count(distinct (a, b)) >= 10""".replace("count(*) n_matches", "count(distinct (a, b)) n_matches"))
def merged_match_counts(spark, d):
    """Matches of both directions merged and deduplicated, pairs of shots with ten or more."""
    m = table(spark, d, "matches").where("im1 is not null and im2 is not null and f1 >= 0 and f2 >= 0 and im1 <> im2")
    swap = F.col("im1") > F.col("im2")
    m = m.select(F.least("im1", "im2").alias("im1"), F.greatest("im1", "im2").alias("im2"), F.when(swap, F.col("f2")).otherwise(F.col("f1")).alias("f1"), F.when(swap, F.col("f1")).otherwise(F.col("f2")).alias("f2")).distinct()
    return m.groupBy("im1", "im2").agg(F.count(F.lit(1)).alias("n_matches")).where("n_matches >= 10")


@query("""with refs as (select distinct shot_id from images where deleted_at is null),
  p as (select distinct least(im1, im2) a, greatest(im1, im2) b from matches where im1 <> im2)
  select case when a in (select shot_id from refs) then a else b end im1, case when a in (select shot_id from refs) then b else a end im2
  from p where a in (select shot_id from refs) or b in (select shot_id from refs)""")
def ordered_pairs(spark, d):
    """Each matched pair once, turned so that the first shot is a reference (one not deleted)."""
    refs = table(spark, d, "images").where("deleted_at is null and shot_id is not null").select("shot_id").distinct().withColumn("ref", F.lit(True))
    p = table(spark, d, "matches").where("im1 <> im2").select(F.least("im1", "im2").alias("a"), F.greatest("im1", "im2").alias("b")).distinct()
    p = p.join(refs.select(F.col("shot_id").alias("a"), F.col("ref").alias("ra")), "a", "left").join(refs.select(F.col("shot_id").alias("b"), F.col("ref").alias("rb")), "b", "left")
    p = p.where("ra or rb")
    return p.select(F.when(F.col("ra"), F.col("a")).otherwise(F.col("b")).alias("im1"), F.when(F.col("ra"), F.col("b")).otherwise(F.col("a")).alias("im2"))


_BAND = """(select im1, im2 from (select a.shot_id im1, b.shot_id im2 from (select *, row_number() over (partition by sequence_key order by shot_id) i from (select distinct sequence_key, shot_id from images where shot_id is not null)) a
  join (select *, row_number() over (partition by sequence_key order by shot_id) i from (select distinct sequence_key, shot_id from images where shot_id is not null)) b
  on a.sequence_key is not distinct from b.sequence_key and b.i >= a.i - 3 and b.i < a.i + 3 and a.i <> b.i))"""


@query(f"select * from {_BAND}")
def order_band_pairs(spark, d):
    return timeline.order_band_pairs(table(spark, d, "images"), "sequence_key", "shot_id", 6)


_NEAR = f"""(select a.shot_id im1, b.shot_id im2, sqrt(pow(a.e - b.e, 2) + pow(a.n - b.n, 2)) dist from {_POS} a join {_POS} b
  on a.sequence_key = b.sequence_key and a.shot_id <> b.shot_id and pow(a.e - b.e, 2) + pow(a.n - b.n, 2) <= 400.0)"""


def _near(spark, d):
    """Shots of one sequence within 20 m, by cells of 20 m: the right side goes to the nine cells around it."""
    p = _positions(spark, d).where("sequence_key is not null")
    cell = lambda c: F.floor(F.col(c) / 20.0)
    a = p.select("sequence_key", F.col("shot_id").alias("im1"), F.col("e").alias("e1"), F.col("n").alias("n1"), cell("e").alias("cx"), cell("n").alias("cy"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    b = p.select("sequence_key", F.col("shot_id").alias("im2"), F.col("e").alias("e2"), F.col("n").alias("n2"), F.explode(steps).alias("s"))
    b = b.select("sequence_key", "im2", "e2", "n2", (F.floor(F.col("e2") / 20.0) + F.col("s.i")).alias("cx"), (F.floor(F.col("n2") / 20.0) + F.col("s.j")).alias("cy"))
    d2 = F.pow(F.col("e1") - F.col("e2"), 2) + F.pow(F.col("n1") - F.col("n2"), 2)
    return a.join(b, ["sequence_key", "cx", "cy"]).where(F.col("im1") != F.col("im2")).where(d2 <= 400.0).select("im1", "im2", F.sqrt(d2).alias("dist"))


@query(f"select im1, im2, round(dist, 6) dist from {_NEAR}")
def gps_radius_pairs(spark, d):
    return _near(spark, d).select("im1", "im2", F.round("dist", 6).alias("dist"))


_CAM = "(select shot_id, min(lower(trim(camera_id))) cam from images where shot_id is not null group by 1)"


@query(f"""select im1, im2, same_camera, rank from (select im1, im2, a.cam is not distinct from b.cam same_camera,
  row_number() over (partition by im1, a.cam is not distinct from b.cam order by dist, im2) rank
  from {_NEAR} p join {_CAM} a on a.shot_id = p.im1 join {_CAM} b on b.shot_id = p.im2) where rank <= 2""")
def same_other_camera_topk(spark, d):
    """Of the shots within the radius, the two nearest of the same camera and the two nearest of others."""
    cam = table(spark, d, "images").where("shot_id is not null").groupBy("shot_id").agg(F.min(F.lower(F.trim("camera_id"))).alias("cam"))
    p = _near(spark, d).join(cam.select(F.col("shot_id").alias("im1"), F.col("cam").alias("c1")), "im1").join(cam.select(F.col("shot_id").alias("im2"), F.col("cam").alias("c2")), "im2")
    p = p.withColumn("same_camera", F.col("c1").eqNullSafe(F.col("c2")))
    w = Window.partitionBy("im1", "same_camera").orderBy("dist", "im2")
    return p.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("im1", "im2", "same_camera", "rank")


@query(f"""select im1, im2, max(band) by_order, max(near) by_distance from (
  select least(im1, im2) im1, greatest(im1, im2) im2, true band, false near from {_BAND}
  union all select least(im1, im2), greatest(im1, im2), false, true from {_NEAR}) group by 1, 2""")
def candidate_union(spark, d):
    """Distinct candidate pairs of two generators, each marked with the generators that proposed it."""
    turn = lambda p: p.select(F.least("im1", "im2").alias("im1"), F.greatest("im1", "im2").alias("im2"))
    a = turn(timeline.order_band_pairs(table(spark, d, "images"), "sequence_key", "shot_id", 6)).withColumns({"b": F.lit(True), "n": F.lit(False)})
    b = turn(_near(spark, d)).withColumns({"b": F.lit(False), "n": F.lit(True)})
    return a.unionByName(b).groupBy("im1", "im2").agg(F.bool_or("b").alias("by_order"), F.bool_or("n").alias("by_distance"))


@query("""with e as (select distinct user_id, event_id, epoch_us(ts) t from events where event_id is not null and ts is not null)
  select im1, im2, gap from (select a.event_id im1, b.event_id im2, abs(a.t - b.t) gap, row_number() over (partition by a.event_id order by abs(a.t - b.t), b.event_id) r
  from e a join e b on a.user_id is not distinct from b.user_id and a.event_id <> b.event_id) where r <= 3""")
def time_knn_pairs(spark, d):
    return timeline.time_neighbours(table(spark, d, "events"), "user_id", "event_id", "ts", 3)


_FIXES = "(select user_id, epoch_us(ts) t, max(value) v from events where event_type = 'purchase' and value is not null group by 1, 2)"


@query(f"""with q as (select event_id, user_id, epoch_us(ts) t from events where event_type <> 'purchase')
  select event_id, round(a.v + (q.t - a.t)::double / (b.t - a.t) * (b.v - a.v), 6) value_at from q
  asof join {_FIXES} a on a.user_id = q.user_id and a.t <= q.t
  asof join {_FIXES} b on b.user_id = q.user_id and b.t > q.t""")
def asof_interpolate(spark, d):
    """The value of a user's purchases at the time of their other events, linear between the two around it."""
    e = table(spark, d, "events")
    r = timeline.asof_interpolated(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), "user_id", "ts", "value", "event_id")
    return r.select("event_id", F.round("value_at", 6).alias("value_at"))


@query(f"""with f as {_FIXES}, r as (select user_id, min(t) t0, max(t) t1 from f group by 1),
  s as (select user_id, unnest(generate_series(t0, t1, 21600000000)) t from r)
  select s.user_id, make_timestamp(s.t) "at", round(case when b.t is null then a.v else a.v + (s.t - a.t)::double / (b.t - a.t) * (b.v - a.v) end, 6) "value" from s
  asof join f a on a.user_id = s.user_id and a.t <= s.t
  asof left join f b on b.user_id = s.user_id and b.t > s.t""")
def resample_dt(spark, d):
    r = timeline.resampled(table(spark, d, "events").where("event_type = 'purchase'"), "user_id", "ts", "value", 6 * 3600)
    return r.select("user_id", F.col("at").cast("timestamp_ntz").alias("at"), F.round("value", 6).alias("value"))


@query(f"""select sequence_key, shot_id, next_key, round(d, 6) distance, round(sum(d) over (partition by sequence_key order by shot_id), 4) travelled from (
  select *, lead(shot_id) over w next_key, sqrt(pow(lead(e) over w - e, 2) + pow(lead(n) over w - n, 2) + pow(lead(u) over w - u, 2)) d
  from {_POS} window w as (partition by sequence_key order by shot_id)) where next_key is not null""")
def path_segments(spark, d):
    p = timeline.path_segments(_positions(spark, d), "sequence_key", "shot_id")
    return p.select("sequence_key", "shot_id", "next_key", F.round("distance", 6).alias("distance"), F.round("travelled", 4).alias("travelled"))


@query(f"""select sequence_key, count(*) n, {", ".join(f"round(avg({a}) + 1e-7, 5) mean_{a}, round(stddev_pop({a}) + 1e-7, 5) std_{a}, round(sqrt(avg({a} * {a})) + 1e-7, 5) rmse_{a}" for a in "enu")},
  round(avg(sqrt(e * e + n * n + u * u)) + 1e-7, 5) mean_norm from {_POS} group by 1""")
def error_summary(spark, d):
    s = statistics.axis_errors(_positions(spark, d), "sequence_key", ["e", "n", "u"])
    return s.select("sequence_key", "n", *(F.round(F.col(c) + 1e-7, 5).alias(c) for c in s.columns if c not in ("sequence_key", "n")))


@query(f"""with m as (select sequence_key, median(e) me, median(n) mn from {_POS} group by 1)
  select p.sequence_key, round(any_value(me), 6) median_e, round(any_value(mn), 6) median_n, round(median(sqrt(pow(e - me, 2) + pow(n - mn, 2))) * 1.486, 6) robust_sigma
  from {_POS} p join m using (sequence_key) group by 1""")
def error_distribution(spark, d):
    s = statistics.robust_spread(_positions(spark, d), "sequence_key", ["e", "n"])
    return s.select("sequence_key", *(F.round(c, 6).alias(c) for c in ("median_e", "median_n", "robust_sigma")))


@query(f"""with v as (select gps_accuracy v from {_POS} where isfinite(gps_accuracy)), r as (select min(v) lo, max(v) hi from v),
  b as (select least(floor((v - lo) / ((hi - lo) / 30)), 29)::int bin, count(*) n from v, r group by 1)
  select range::int bin, coalesce(n, 0) n from range(30) left join b on b.bin = range""")
def histogram_30(spark, d):
    return statistics.equal_width_histogram(_positions(spark, d).where(F.abs("gps_accuracy") < float("inf")), "gps_accuracy", 30)


@query(f"""select sequence_key, round(sum(w * e) / sum(w), 6) east, round(sum(w * n) / sum(w), 6) north from (
  select *, 1 / greatest(0.01, coalesce(nullif(gps_accuracy, 0), 15)) w from {_POS} where not isnan(coalesce(gps_accuracy, 0))) group by 1""")
def weighted_reference(spark, d):
    w = 1 / F.greatest(F.lit(0.01), F.coalesce(F.nullif(F.col("gps_accuracy"), F.lit(0.0)), F.lit(15.0)))
    p = _positions(spark, d).where(~F.isnan(F.coalesce("gps_accuracy", F.lit(0.0)))).withColumn("w", w)
    mean = lambda c: F.round(F.sum(F.col("w") * F.col(c)) / F.sum("w"), 6)
    return p.groupBy("sequence_key").agg(mean("e").alias("east"), mean("n").alias("north"))


@query("""with o as (select distinct id, o.shot_id shot_id, sqrt(pow(o.projection[1], 2) + pow(o.projection[2], 2)) err from (select id, unnest(observations) o from ground_control_points))
  select id, arg_max(shot_id, (err, shot_id)) worst_shot, round(max(err), 6) worst_error from o where err is not null and shot_id is not null group by 1""")
def worst_gcp(spark, d):
    """Per control point the shot whose projection lies farthest from the centre of the image."""
    o = table(spark, d, "ground_control_points").select("id", F.explode("observations").alias("o")).distinct()
    at = lambda i: F.get("o.projection", F.lit(i))
    o = o.select("id", F.col("o.shot_id").alias("shot_id"), F.sqrt(at(0) * at(0) + at(1) * at(1)).alias("err")).where("err is not null and shot_id is not null and id is not null")
    return o.groupBy("id").agg(F.max(F.struct("err", "shot_id")).alias("m")).select("id", F.col("m.shot_id").alias("worst_shot"), F.round("m.err", 6).alias("worst_error"))


@query("""with s as (select distinct g.id, i.sequence_key from (select id, lower(trim(unnest(observations).shot_id)) shot_id from ground_control_points) g join images i on lower(i.shot_id) = g.shot_id)
  select distinct a.sequence_key r1, b.sequence_key r2 from s a join s b on a.id = b.id and a.sequence_key < b.sequence_key""")
def connected_reconstructions(spark, d):
    """Sequences that see a control point together."""
    g = table(spark, d, "ground_control_points").select("id", F.explode("observations.shot_id").alias("s")).select("id", F.lower(F.trim("s")).alias("shot_id"))
    s = g.join(table(spark, d, "images").select(F.lower("shot_id").alias("shot_id"), "sequence_key"), "shot_id").select("id", "sequence_key").distinct()
    a, b = s.select("id", F.col("sequence_key").alias("r1")), s.select("id", F.col("sequence_key").alias("r2"))
    return a.join(b, "id").where("r1 < r2").select("r1", "r2").distinct()


@query("""select a.p type1, b.p type2, count(*) n_pairs from (select distinct im1, im2 from matches where im1 is not null and im2 is not null) m
  join (select shot_id, min(projection_type) p from exif where shot_id is not null group by 1) a on a.shot_id = im1
  join (select shot_id, min(projection_type) p from exif where shot_id is not null group by 1) b on b.shot_id = im2 group by 1, 2""")
def projection_type_pairs(spark, d):
    e = table(spark, d, "exif").where("shot_id is not null").groupBy("shot_id").agg(F.min("projection_type").alias("p"))
    m = table(spark, d, "matches").where("im1 is not null and im2 is not null").select("im1", "im2").distinct()
    m = m.join(e.select(F.col("shot_id").alias("im1"), F.col("p").alias("type1")), "im1").join(e.select(F.col("shot_id").alias("im2"), F.col("p").alias("type2")), "im2")
    return m.groupBy("type1", "type2").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("""select camera_id, arg_min(projection_type, created_at) projection_type, arg_min(width, created_at) width, arg_min(height, created_at) height, round(arg_min(focal, created_at), 6) focal
  from cameras group by 1""")
def first_camera_models(spark, d):
    """Of several lifetimes of a camera the first one's parameters."""
    first = F.min(F.struct("created_at", "projection_type", "width", "height", "focal")).alias("f")
    g = table(spark, d, "cameras").where("created_at is not null").groupBy("camera_id").agg(first)
    return g.select("camera_id", "f.projection_type", "f.width", "f.height", F.round("f.focal", 6).alias("focal"))


@query("""select distinct shot_id, lower(concat_ws(' ', 'v2', trim(make, ' '), trim(replace(model, make, ''), ' '), width, height::varchar, projection_type, left(focal_ratio, 6))) camera from exif
  where make is not null and make <> '' and model is not null and width is not null and height is not null and projection_type is not null and focal_ratio is not null""")
def camera_keys(spark, d):
    need = ["make", "model", "width", "height", "projection_type", "focal_ratio"]
    e = table(spark, d, "exif").where(" and ".join(f"{c} is not null" for c in need) + " and make <> ''")
    return e.select("shot_id", fx.camera_key("make", "model", "width", "height", "projection_type", "focal_ratio").alias("camera")).distinct()


@query("""select rig, count(*) n_instances from (select sequence_key, array_to_string(list_sort(list(distinct rig_camera_id)), ',') rig from images where rig_camera_id is not null group by 1) group by 1""")
def rig_groups(spark, d):
    """Sequences by the set of rig cameras that they hold."""
    g = table(spark, d, "images").where("rig_camera_id is not null").groupBy("sequence_key").agg(F.array_join(F.array_sort(F.collect_set("rig_camera_id")), ",").alias("rig"))
    return g.groupBy("rig").agg(F.count(F.lit(1)).alias("n_instances"))


@query("""with r as (select sequence_key, reference_lla.latitude la, reference_lla.longitude lo, lead(reference_lla.latitude) over (order by sequence_key) la2, lead(reference_lla.longitude) over (order by sequence_key) lo2 from (select distinct sequence_key, reference_lla from image_groups))
  select sequence_key, round((degrees(atan2(sin(radians(lo2 - lo)) * cos(radians(la2)), cos(radians(la)) * sin(radians(la2)) - sin(radians(la)) * cos(radians(la2)) * cos(radians(lo2 - lo)))) + 360) % 360, 4) "bearing" from r where la2 is not null""")
def group_bearings(spark, d):
    """Initial bearing from each group's reference to the next group's."""
    g = table(spark, d, "image_groups").select("sequence_key", "reference_lla").distinct()
    g = ranked(g, ["sequence_key"], "at")
    g = g.join(g.select((F.col("at") - 1).alias("at"), F.col("reference_lla").alias("next")), "at").where("next is not null")
    b = geo.bearing_degrees("reference_lla.latitude", "reference_lla.longitude", "next.latitude", "next.longitude")
    return g.select("sequence_key", F.round(b, 4).alias("bearing"))


_EMB = "(select vec_id, embedding::double[] v from embeddings)"


@query(f"""select query, other, round(distance, 6) distance from (select q.vec_id query, o.vec_id other, list_distance(q.v, o.v) distance,
  row_number() over (partition by q.vec_id order by list_distance(q.v, o.v), o.vec_id) r from {_EMB} q join {_EMB} o on q.vec_id % 50 = 0 and q.vec_id <> o.vec_id) where r <= 10""")
def vector_topk(spark, d):
    """The ten nearest of all vectors for every vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    return retrieval.nearest_vectors(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10).select("query", "other", F.round("distance", 6).alias("distance"))


@query(f"""select query, other, round(distance, 6) distance from (select q.vec_id query, o.vec_id other, list_distance(q.v, o.v) distance,
  row_number() over w r, lead(list_distance(q.v, o.v)) over w nxt from {_EMB} q join {_EMB} o on q.vec_id <> o.vec_id
  window w as (partition by q.vec_id order by list_distance(q.v, o.v), o.vec_id)) where r = 1 and distance < 0.95 * nxt""")
def lowe_ratio_matches(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.ratio_matches(retrieval.nearest_vectors(e, e, "vec_id", "embedding", 2), 0.95).select("query", "other", F.round("distance", 6).alias("distance"))


@query(f"""with n as (select q.vec_id a, arg_min(o.vec_id, (list_distance(q.v, o.v), o.vec_id)) b from {_EMB} q join {_EMB} o on q.vec_id <> o.vec_id group by 1)
  select x.a im1, x.b im2 from n x join n y on x.b = y.a and y.b = x.a and x.a < x.b""")
def mutual_matches(spark, d):
    e = table(spark, d, "embeddings")
    n = retrieval.nearest_vectors(e, e, "vec_id", "embedding", 1).select(F.col("query").alias("im1"), F.col("other").alias("im2"))
    return n.intersect(n.select(F.col("im2").alias("im1"), F.col("im1").alias("im2"))).where("im1 < im2")


_TF = r"""tf as (select doc_id, word, count(*) n from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) word from documents) group by 1, 2),
  fr as (select word, sum(n) freq from tf group by 1), raw as (select doc_id, word, n * ln((select sum(freq) from fr) / freq) r from tf join fr using (word)),
  h as (select doc_id, word, r / sum(r) over (partition by doc_id) weight from raw)"""


def _words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}]+)")).alias("words"))


@query(f"with {_TF} select doc_id, word, round(weight, 6) weight from h")
def bow_histograms(spark, d):
    return retrieval.word_histograms(_words(spark, d), "doc_id", "words").select("doc_id", "word", F.round("weight", 6).alias("weight"))


@query(f"""with {_TF}, s as (select q.doc_id query, o.doc_id other, abs(round(2 - 2 * sum(least(q.weight, o.weight)), 9)) distance from h q join h o using (word)
  where q.doc_id % 50 = 0 and q.doc_id <> o.doc_id group by 1, 2),
  f as (select q.doc_id query, o.doc_id other, 2.0 distance from (select distinct doc_id from documents where doc_id % 50 = 0) q, (select distinct doc_id from documents where doc_id is not null order by 1 limit 10) o
    where q.doc_id <> o.doc_id and not exists (from s where s.query = q.doc_id and s.other = o.doc_id))
  select query, other, round(distance, 6) distance from (select *, row_number() over (partition by query order by distance, other) r from (from s union all from f)) where r <= 5""")
def bow_topk(spark, d):
    """The five nearest documents for every document whose id is divisible by 50; what shares no word is at distance 2.

    A query with fewer than five partners that share a word takes the smallest other ids, of which ten are enough.
    """
    shared = retrieval.word_neighbours(_words(spark, d), "doc_id", "words", F.expr("doc_id % 50 = 0"), 5)
    ids = table(spark, d, "documents").where("doc_id is not null").select("doc_id").distinct()
    first = ids.orderBy("doc_id").limit(10).agg(F.array_sort(F.collect_list("doc_id")).alias("first"))
    rest = ids.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query")).join(F.broadcast(first)).select("query", F.explode("first").alias("other"), F.lit(2.0).alias("distance"))
    rest = rest.where("query <> other").join(shared.select("query", "other"), ["query", "other"], "left_anti")
    w = Window.partitionBy("query").orderBy("distance", "other")
    return shared.unionByName(rest).withColumn("r", F.row_number().over(w)).where("r <= 5").select("query", "other", F.round("distance", 6).alias("distance"))


@query("""with x as (select vec_id, label image, unnest(embedding::double[]) v, unnest(range(64)) dim from embeddings),
  c as (select vec_id % 8 centre, dim, avg(v) cv from x group by 1, 2),
  d as (select x.vec_id, c.centre, sum(pow(x.v - c.cv, 2)) d from x join c using (dim) group by 1, 2),
  n as (select vec_id, arg_min(centre, (d, centre)) centre from d group by 1),
  s as (select image, centre, dim, sum(v - cv) r from x join n using (vec_id) join c using (centre, dim) group by 1, 2, 3)
  select image, centre, dim::int dim, round(r / sqrt(sum(r * r) over (partition by image)), 6) "value" from s""")
def vlad_vectors(spark, d):
    """Vectors of residuals of each label's features about eight centres (means of the ids' remainders)."""
    return vlad_parts(spark, d).select("image", "centre", "dim", F.round("value", 6).alias("value"))


def vlad_parts(spark, d):
    """image, centre, dim, value of the residual vectors, unrounded."""
    e = table(spark, d, "embeddings").withColumn("image", F.col("label"))
    parts = e.select((F.col("vec_id") % 8).alias("centre"), F.posexplode("embedding").alias("dim", "v"))
    means = parts.groupBy("centre", "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centres = means.groupBy("centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("c"))
    return retrieval.residual_vectors(e, centres, "image", "embedding")


@query()
def submodels(spark, d):
    """Control points in clusters of about 100, with the points of other clusters within 30 m."""
    p = table(spark, d, "ground_control_points").select("id", F.col("position.latitude").alias("lat"), F.col("position.longitude").alias("lon")).where("lat is not null and lon is not null").distinct()
    c = graph.clustered(p, 100)
    pairs = proximity.near_pairs(p, p, 30.0)
    return pairs.join(c.select(F.col("id").alias("left_id"), "submodel"), "left_id").select("submodel", F.col("right_id").alias("id")).distinct()


@query("""select sequence_key, shot_id, round(e, 6) e from (select *, row_number() over (partition by sequence_key order by shot_id) r from (select distinct sequence_key, shot_id, e from """ + _POS + """)) where r <= 10""")
def first_shots(spark, d):
    """The first ten shots of each sequence."""
    w = Window.partitionBy("sequence_key").orderBy("shot_id")
    return _positions(spark, d).select("sequence_key", "shot_id", "e").distinct().withColumn("r", F.row_number().over(w)).where("r <= 10").select("sequence_key", "shot_id", F.round("e", 6).alias("e"))
