"""Queries for operators on reconstructions, and the SQL that gives the same rows.

A sequence stands for a reconstruction: its shots are level cameras at the recorded positions that look along the
compass, with the camera that the image names; the point of a track lies ten metres before, and a little above, the mean
of its shots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import camera
from ..operators import graph, observations, statistics, timeline
from ..operators import reconstruction as rec
from ..operators import retrieval
from ..runtime import ranked, table
from . import scene

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _shots(spark, d) -> DataFrame:
    p = table(spark, d, "shot_measurements").select("shot_id", F.col("sequence_key").alias("reconstruction_id"), *(F.get("gps_position", F.lit(i)).alias(a) for i, a in enumerate("enu")), "compass_angle")
    p = p.where("shot_id is not null and abs(e) <= 5000 and abs(n) <= 5000 and abs(u) <= 5000").groupBy("shot_id").agg(
        F.min("reconstruction_id").alias("reconstruction_id"), *(F.min(a).alias(a) for a in "enu"), F.radians(F.coalesce(F.min("compass_angle"), F.lit(0.0))).alias("heading")
    )
    name = F.lower(F.trim("camera_id"))
    own = table(spark, d, "images").where("shot_id is not null").groupBy("shot_id").agg(F.min(name).alias("cam"))
    cams = table(spark, d, "cameras").where("camera_id is not null").groupBy(name.alias("cam")).agg(
        F.min("projection_type").alias("kind"), *(F.coalesce(F.min(c), F.lit(0.0)).alias(c) for c in ("focal", "k1", "k2")), F.min("width").alias("width"), F.min("height").alias("height")
    )
    return p.join(own, "shot_id").join(F.broadcast(cams), "cam")  # cameras are a fixed list of some hundreds


def _tracks(spark, d) -> DataFrame:
    return observations.in_good_tracks(scene._obs(spark, d))


def _slim_tracks(spark, d, *columns: str) -> DataFrame:
    """shot_id, track_id and ``columns`` of :func:`_tracks`, by track: what else tells rows apart is one number, and they move once."""
    o = table(spark, d, "observations").where("shot_id is not null and track_id is not null and feature_id is not null")
    kept = ["shot_id", "track_id", *columns]
    other = [c for c in o.columns if c not in kept]
    o = o.select(*kept, F.xxhash64(*other, *(F.col(c).isNull() for c in other)).alias("_other")).repartition("track_id").distinct()
    return observations.in_good_tracks(o).drop("_other")


def _points(spark, d, tracks: DataFrame | None = None) -> DataFrame:
    o = (tracks or _tracks(spark, d)).select("shot_id", "track_id").join(_shots(spark, d), "shot_id")
    ahead = {"px": F.col("e") + 10 * F.sin("heading"), "py": F.col("n") + 10 * F.cos("heading"), "pz": F.col("u") + 0.31415926}
    g = o.groupBy("reconstruction_id", "track_id").agg(F.count(F.lit(1)).alias("views"), *(F.avg(c).alias(a) for a, c in ahead.items()))
    return g.where("views >= 2").select("reconstruction_id", "track_id", "px", "py", "pz")


def _projections(spark, d) -> DataFrame:
    o = _tracks(spark, d).select("shot_id", "track_id", "feature_id", "x", "y", "scale")
    return rec.reprojections(o, _shots(spark, d), _points(spark, d))


_SCENE = f"""gobs as (select * from {scene._GOBS}),
shots as (select s.*, c.* exclude (cam) from (
    select shot_id, min(sequence_key) reconstruction_id, min(gps_position[1]) e, min(gps_position[2]) n, min(gps_position[3]) u, radians(coalesce(min(compass_angle), 0)) heading
    from shot_measurements where shot_id is not null and abs(gps_position[1]) <= 5000 and abs(gps_position[2]) <= 5000 and abs(gps_position[3]) <= 5000 group by 1) s
  join (select shot_id, min(lower(trim(camera_id))) cam from images where shot_id is not null group by 1) i using (shot_id)
  join (select lower(trim(camera_id)) cam, min(projection_type) kind, coalesce(min(focal), 0) focal, coalesce(min(k1), 0) k1, coalesce(min(k2), 0) k2, min(width) width, min(height) height
    from cameras where camera_id is not null group by 1) c using (cam)),
points as (select reconstruction_id, track_id, avg(e + 10 * sin(heading)) px, avg(n + 10 * cos(heading)) py, avg(u + 0.31415926) pz
  from gobs join shots using (shot_id) group by 1, 2 having count(*) >= 2),
cams as (select o.shot_id, o.track_id, o.feature_id, o.x, o.y, o.scale, s.*  exclude (shot_id), p.px, p.py, p.pz,
    cos(heading) * (px - e) - sin(heading) * (py - n) cx, -(pz - u) cy, sin(heading) * (px - e) + cos(heading) * (py - n) cz
  from gobs o join shots s using (shot_id) join points p using (reconstruction_id, track_id)),
bent as (select *, cx * cx + cy * cy flat, cz > 0 and cx * cx + cy * cy < 4 * cz * cz seen, atan2(sqrt(cx * cx + cy * cy), cz) t from cams),
proj as (select *, case
    when kind in ('perspective', 'brown') and seen then cx * focal / cz * (1 + flat / (cz * cz) * (k1 + flat / (cz * cz) * k2))
    when kind = 'fisheye' and seen and flat > 0 then cx * focal / sqrt(flat) * t * (1 + t * t * (k1 + t * t * k2))
    when kind = 'spherical' and flat + cz * cz > 0 then atan2(cx, cz) / (2 * pi()) end pu, case
    when kind in ('perspective', 'brown') and seen then cy * focal / cz * (1 + flat / (cz * cz) * (k1 + flat / (cz * cz) * k2))
    when kind = 'fisheye' and seen and flat > 0 then cy * focal / sqrt(flat) * t * (1 + t * t * (k1 + t * t * k2))
    when kind = 'spherical' and flat + cz * cz > 0 then atan2(cy, sqrt(cx * cx + cz * cz)) / (2 * pi()) end pv from bent),
errs as (select *, sqrt(pow(x - pu, 2) + pow(y - pv, 2)) error from proj where pu is not null and pv is not null)"""


@query(f"with {_SCENE} select shot_id, track_id, feature_id, round(error * greatest(width, height), 4) pixels, round(error / nullif(scale, 0), 3) normalized from errs")
def reprojection_errors(spark, d):
    e = rec.with_errors(_projections(spark, d))
    return e.select("shot_id", "track_id", "feature_id", F.round("pixels", 4).alias("pixels"), F.round("normalized", 3).alias("normalized"))


@query()
def angular_errors(spark, d):
    """Per reconstruction the mean angle between observed and projected rays; the distortion is undone by iteration, which has no SQL."""
    return rec.with_errors(_projections(spark, d)).groupBy("reconstruction_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("angle"), 6).alias("mean_angle"))


@query(f"""with {_SCENE}, v as (select error v from errs where error <= 4), r as (select min(v) lo, max(v) hi from v),
  b as (select least(floor((v - lo) / ((hi - lo) / 30)), 29)::int bin, count(*) n from v, r group by 1)
  select range::int bin, coalesce(n, 0) n from range(30) left join b on b.bin = range""")
def reprojection_histogram(spark, d):
    """Thirty bins of the errors up to four image sizes."""
    return statistics.equal_width_histogram(rec.with_errors(_projections(spark, d)).where("error <= 4").select("error"), "error", 30)


@query(f"""with {_SCENE} select kind, bx, by_, count(*) n, round(avg(x - pu), 6) dx, round(avg(y - pv), 6) dy from (
  select *, least(greatest(floor((x + 0.5) * 20), 0), 19)::int bx, least(greatest(floor((y + 0.5) * 20), 0), 19)::int by_ from errs where error <= 4) group by 1, 2, 3""")
def residual_heatmap(spark, d):
    """Mean residual vector by camera type and cell of the image."""
    bx, by = statistics.grid_cells(F.col("x"), F.col("y"), 20, 20, 1.0, 1.0)
    e = rec.with_errors(_projections(spark, d)).where("error <= 4")
    return e.groupBy("kind", bx.alias("bx"), by.alias("by_")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x") - F.col("pu")), 6).alias("dx"), F.round(F.avg(F.col("y") - F.col("pv")), 6).alias("dy"))


@query(f"""with {_SCENE}, m as (select *, error * error > 0.25 bad from errs), s as (select reconstruction_id, track_id from m group by 1, 2 having count(*) filter (bad) = 0 or count(*) filter (not bad) >= 2)
  select shot_id, track_id, feature_id from m semi join s using (reconstruction_id, track_id) where not bad""")
def reprojection_inliers(spark, d):
    """Observations that project to within half an image; tracks left with fewer than two by that lose all."""
    e = rec.with_errors(_projections(spark, d)).withColumnRenamed("track_id", "_t").withColumn("track_id", F.struct("reconstruction_id", "_t"))
    return observations.remove_outliers(e, F.col("error") * F.col("error"), 0.5).select("shot_id", F.col("_t").alias("track_id"), "feature_id")


@query(f"""with {_SCENE} select shot_id, track_id, abs(pu) < width / greatest(width, height) / 2 and abs(pv) < height / greatest(width, height) / 2 inside from errs""")
def valid_observations(spark, d):
    """Observations of points before the camera, and whether the point projects into its frame."""
    p = _projections(spark, d).where("pu is not null and pv is not null")
    return p.select("shot_id", "track_id", camera.inside_frame("pu", "pv", "width", "height").alias("inside"))


@query(f"""with {_SCENE}, g as (select shot_id, count(distinct track_id) n from cams group by 1)
  select min(n) min_features, max(n) max_features, floor(avg(n))::bigint mean_features, floor(median(n))::bigint median_features from g""")
def features_reconstructed(spark, d):
    """Features with a point per shot; shots without any are left out."""
    g = _projections(spark, d).groupBy("shot_id").agg(F.count_distinct("track_id").alias("n"))
    return g.agg(F.min("n").alias("min_features"), F.max("n").alias("max_features"), F.floor(F.avg("n")).alias("mean_features"), F.floor(F.percentile("n", 0.5)).alias("median_features"))


@query(f"""with {_SCENE}, q as (select reconstruction_id || '/' || track_id k, px, py, pz from points),
  n as (select a.k, pow(a.px - b.px, 2) + pow(a.py - b.py, 2) + pow(a.pz - b.pz, 2) d2, row_number() over (partition by a.k order by pow(a.px - b.px, 2) + pow(a.py - b.py, 2) + pow(a.pz - b.pz, 2), b.k) r
    from q a join q b on a.k <> b.k), m as (select k, avg(d2) mean2 from n where r <= 3 group by 1)
  select k, round(mean2, 3) mean2 from m where mean2 > (select avg(mean2) + 1.25 * stddev_pop(mean2) from m)""")
def isolated_points(spark, d):
    """Points far from their three nearest, all reconstructions laid over one another."""
    q = _points(spark, d, _slim_tracks(spark, d)).select(F.concat("reconstruction_id", F.lit("/"), "track_id").alias("k"), "px", "py", "pz")
    near = retrieval.nearest_distances(q, "k", ["px", "py", "pz"], 3).select("k", F.explode("distances").alias("distance")).select("k", F.pow("distance", 2).alias("d2"))
    return rec.isolated(near, "k").select("k", F.round("mean2", 3).alias("mean2"))


@query(f"""with {_SCENE} select reconstruction_id, shot_id, round(quantile_cont(cz, 0.1) * 0.9, 4) min_depth, round(quantile_cont(cz, 0.9) * 1.1, 4) max_depth from cams group by 1, 2""")
def depth_range(spark, d):
    r = rec.depth_ranges(_projections(spark, d))
    return r.select("reconstruction_id", "shot_id", F.round("min_depth", 4).alias("min_depth"), F.round("max_depth", 4).alias("max_depth"))


@query(f"""with {_SCENE}, v as (select reconstruction_id, track_id, shot_id, e - px a, n - py b, u - pz c from cams),
  s as (select x.shot_id, y.shot_id other, acos(least(greatest((x.a * y.a + x.b * y.b + x.c * y.c) / nullif(sqrt((x.a * x.a + x.b * x.b + x.c * x.c) * (y.a * y.a + y.b * y.b + y.c * y.c)), 0), -1), 1)) t
    from v x join v y using (reconstruction_id, track_id) where x.shot_id <> y.shot_id),
  g as (select shot_id, other, count(*) score from s where t > pi() / 60 and t < pi() / 6 group by 1, 2)
  select shot_id, other, score from (select *, row_number() over (partition by shot_id order by score desc, other) r from g where score > 2) where r <= 5""")
def neighbouring_images(spark, d):
    return rec.neighbouring_shots(_tracks(spark, d), _shots(spark, d), _points(spark, d), 2, 5)


@query(f"""with {_SCENE} select shot_id, track_id, feature_id from cams""")
def correspondences(spark, d):
    """Observations whose shot and point are both reconstructed."""
    return _projections(spark, d).select("shot_id", "track_id", "feature_id")


@query(f"""with {_SCENE} select reconstruction_id, track_id, arg_min(shot_id, (pow(px - e, 2) + pow(py - n, 2) + pow(pz - u, 2), shot_id)) shot_id from cams group by 1, 2""")
def nearest_observer(spark, d):
    """Per point the nearest of the shots that see it, whose movement it follows when the map is realigned."""
    d2 = F.pow(F.col("px") - F.col("e"), 2) + F.pow(F.col("py") - F.col("n"), 2) + F.pow(F.col("pz") - F.col("u"), 2)
    g = _projections(spark, d).groupBy("reconstruction_id", "track_id").agg(F.min(F.struct(d2.alias("d"), "shot_id")).alias("m"))
    return g.select("reconstruction_id", "track_id", F.col("m.shot_id").alias("shot_id"))


@query(f"""with {_SCENE} select reconstruction_id, track_id, round(2 * (0.8 * px - 0.6 * py) + 100, 5) x, round(2 * (0.6 * px + 0.8 * py) - 50, 5) y, round(2 * pz + 3, 5) z from points""")
def transformed_points(spark, d):
    """Points under a similarity (scale, rotation, shift)."""
    x, y, z = camera.moved("px", "py", "pz", 2.0, [[0.8, -0.6, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]], [100.0, -50.0, 3.0])
    return _points(spark, d).select("reconstruction_id", "track_id", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), F.round(z, 5).alias("z"))


_RAYS = """r as (select reconstruction_id, track_id, shot_id, e ox, n oy, u oz, (px - e) / s bx, (py - n) / s by_, (pz - u) / s bz from (
    select *, sqrt(pow(px - e, 2) + pow(py - n, 2) + pow(pz - u, 2)) s from cams) where s > 0),
  a as (select reconstruction_id, track_id, count(*) n, sum(1 - bx * bx) xx, sum(-bx * by_) xy, sum(-bx * bz) xz, sum(1 - by_ * by_) yy, sum(-by_ * bz) yz, sum(1 - bz * bz) zz from r group by 1, 2)"""


@query(f"""with {_SCENE}, {_RAYS} select reconstruction_id, track_id, n, round(px, 3) x, round(py, 3) y, round(pz, 3) z
  from a join points using (reconstruction_id, track_id) where n >= 2 and abs(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)) > 1e-4""")
def triangulated_tracks(spark, d):
    """Each point found again from the rays to it; nearly parallel rays give none."""
    p = _projections(spark, d)
    rays = p.select("reconstruction_id", "track_id", F.col("e").alias("ox"), F.col("n").alias("oy"), F.col("u").alias("oz"), *((F.col(a) - F.col(b)).alias(c) for a, b, c in (("px", "e", "bx"), ("py", "n", "by"), ("pz", "u", "bz"))))
    size = F.sqrt(F.col("bx") * F.col("bx") + F.col("by") * F.col("by") + F.col("bz") * F.col("bz"))
    b = rays.where(size > 0).withColumns({c: F.col(c) / size for c in ("bx", "by", "bz")})
    s = lambda c: F.sum(c)
    g = b.groupBy("reconstruction_id", "track_id").agg(
        s(1 - F.col("bx") * F.col("bx")).alias("xx"), s(-F.col("bx") * F.col("by")).alias("xy"), s(-F.col("bx") * F.col("bz")).alias("xz"),
        s(1 - F.col("by") * F.col("by")).alias("yy"), s(-F.col("by") * F.col("bz")).alias("yz"), s(1 - F.col("bz") * F.col("bz")).alias("zz"),
    )
    well = g.where("abs(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)) > 1e-4").select("reconstruction_id", "track_id")
    found = rec.triangulated(rays.join(well, ["reconstruction_id", "track_id"], "left_semi"), ["reconstruction_id", "track_id"], min_depth=-1e9)
    return found.select("reconstruction_id", "track_id", "n", *(F.round(a, 3).alias(a) for a in "xyz"))


@query(f"""with {_SCENE} select reconstruction_id, count(*) n_shots, round((max(e) - min(e)) * (max(n) - min(n)), 2) area from shots group by 1""")
def scene_area(spark, d):
    extent = lambda a: F.max(a) - F.min(a)
    return _shots(spark, d).groupBy("reconstruction_id").agg(F.count(F.lit(1)).alias("n_shots"), F.round(extent("e") * extent("n"), 2).alias("area"))


@query(f"""with {_SCENE} select reconstruction_id, count(*) n_shots from shots group by 1""")
def largest_reconstructions(spark, d):
    """Reconstructions by number of shots, the largest first."""
    return _shots(spark, d).groupBy("reconstruction_id").agg(F.count(F.lit(1)).alias("n_shots")).orderBy(F.desc("n_shots"), "reconstruction_id")


@query(f"""with {_SCENE}, z as (select reconstruction_id, count(*) size from shots group by 1)
  select kind, width, height, arg_max(reconstruction_id, (size, reconstruction_id)) reconstruction_id, max(size) n_shots from (select distinct kind, width, height, reconstruction_id from shots) join z using (reconstruction_id) group by 1, 2, 3""")
def camera_statistics(spark, d):
    """Per kind and size of camera the largest reconstruction that holds it, whose values count."""
    s = _shots(spark, d)
    size = s.groupBy("reconstruction_id").agg(F.count(F.lit(1)).alias("size"))
    g = s.select("kind", "width", "height", "reconstruction_id").distinct().join(size, "reconstruction_id").groupBy("kind", "width", "height").agg(F.max(F.struct("size", "reconstruction_id")).alias("m"))
    return g.select("kind", "width", "height", F.col("m.reconstruction_id").alias("reconstruction_id"), F.col("m.size").alias("n_shots"))


@query(f"""with {_SCENE} select 'reconstruction' section, 'n_shots' name, count(*)::double "value" from shots union all select 'reconstruction', 'n_points', count(*) from points
  union all select 'features', 'n_observations', count(*) from cams union all select 'errors', 'mean_error', round(avg(error), 6) from errs where error <= 4
  union all select 'cameras', 'n_kinds', count(distinct kind) from shots""")
def scene_statistics(spark, d):
    """All sections of the summary as rows."""
    shots, points, p = _shots(spark, d), _points(spark, d), _projections(spark, d)
    one = lambda df, section, name, value: df.agg(value.cast("double").alias("value")).select(F.lit(section).alias("section"), F.lit(name).alias("name"), "value")
    n = F.count(F.lit(1))
    parts = [one(shots, "reconstruction", "n_shots", n), one(points, "reconstruction", "n_points", n), one(p, "features", "n_observations", n),
             one(rec.with_errors(p).where("error <= 4"), "errors", "mean_error", F.round(F.avg("error"), 6)), one(shots, "cameras", "n_kinds", F.count_distinct("kind"))]
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


@query(f"""with {_SCENE}, q as (select *, row_number() over (partition by reconstruction_id order by shot_id) i from shots),
  w as (select reconstruction_id, shot_id, sum(coalesce(dist, 0)) over (partition by reconstruction_id order by shot_id rows unbounded preceding) / 2.5 t from (
    select a.reconstruction_id, a.shot_id, sqrt(pow(a.e - b.e, 2) + pow(a.n - b.n, 2) + pow(a.u - b.u, 2)) dist from q a left join q b on a.reconstruction_id = b.reconstruction_id and b.i = a.i - 1))
  select reconstruction_id, shot_id, round(t, 5) "seconds" from w""")
def cumulative_time(spark, d):
    """Time of each shot of a sequence that is travelled at 2.5 metres a second."""
    s = _shots(spark, d)
    path = timeline.path_segments(s.select("reconstruction_id", "shot_id", "e", "n", "u"), "reconstruction_id", "shot_id").select("reconstruction_id", F.col("next_key").alias("shot_id"), "travelled")
    return s.join(path, ["reconstruction_id", "shot_id"], "left").select("reconstruction_id", "shot_id", F.round(F.coalesce("travelled", F.lit(0.0)) / 2.5, 5).alias("seconds"))


@query(f"""with {_SCENE}, w as (select reconstruction_id, shot_id, e - (lag(e) over o + lead(e) over o) / 2 a, n - (lag(n) over o + lead(n) over o) / 2 b, u - (lag(u) over o + lead(u) over o) / 2 c
  from shots window o as (partition by reconstruction_id order by shot_id)) select reconstruction_id, shot_id, round(sqrt(a * a + b * b + c * c), 5) error from w where a is not null""")
def motion_errors(spark, d):
    return rec.linear_motion(_shots(spark, d), "reconstruction_id", "shot_id", ["e", "n", "u"]).select("reconstruction_id", "shot_id", F.round("error", 5).alias("error"))


@query(f"""select im1, im2, round(dist, 6) dist from (select *, row_number() over (partition by im1 order by dist, im2) r from {scene._NEAR}) where r <= 4""")
def gps_knn_pairs(spark, d):
    """The four nearest shots of a sequence within 20 m of each."""
    w = Window.partitionBy("im1").orderBy("dist", "im2")
    return scene._near(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 4").select("im1", "im2", F.round("dist", 6).alias("dist"))


@query(scene.ORACLE["vlad_vectors"].rsplit("select image, centre, dim::int dim", 1)[0] + """, h as (select image, centre * 64 + dim i, r / sqrt(sum(r * r) over (partition by image)) w from s),
  p as (select a.image query, b.image other, sqrt(sum(pow(a.w - b.w, 2))) distance from
    (select x.image, i, coalesce(w, 0) w from (select * from (select distinct image from h), (select unnest(range(512)) i)) x left join h using (image, i)) a join
    (select x.image, i, coalesce(w, 0) w from (select * from (select distinct image from h), (select unnest(range(512)) i)) x left join h using (image, i)) b on a.i = b.i and a.image <> b.image group by 1, 2)
  select query, other, round(distance, 6) distance from (select *, row_number() over (partition by query order by distance, other) r from p) where r <= 3""")
def vlad_topk(spark, d):
    """The three nearest images (labels) by their vectors of residuals; centres without features count as zeros."""
    v = scene.vlad_parts(spark, d)
    entries = v.select("image", (F.col("centre") * 64 + F.col("dim")).cast("int").alias("i"), "value").groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("m"))
    vectors = entries.select("image", F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))
    return retrieval.nearest_vectors(vectors, vectors, "image", "v", 3).select("query", "other", F.round("distance", 6).alias("distance"))


@query(f"""with p as (select a.shot_id im1, b.shot_id im2, b.x - a.x dx, b.y - a.y dy from {scene._GOBS} a join {scene._GOBS} b on a.track_id = b.track_id and a.shot_id < b.shot_id),
  m as (select im1, im2, median(dx) mx, median(dy) my, count(*) n from p group by 1, 2 having count(*) >= 3),
  o as (select im1, im2, n, count(*) filter (sqrt(pow(dx - mx, 2) + pow(dy - my, 2)) > 0.1) outliers from p join m using (im1, im2) group by 1, 2, 3)
  select im1, im2, outliers score from o where outliers >= 0.3 * n and outliers > 0""")
def pair_reconstructability(spark, d):
    """Pairs of images by how many common features a mere shift does not explain, those with a share of 0.3 or more, the best first."""
    o = _tracks(spark, d)
    side = lambda i: o.select("track_id", F.col("shot_id").alias(f"im{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    p = side(1).join(side(2), "track_id").where("im1 < im2").select("im1", "im2", (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    m = p.groupBy("im1", "im2").agg(F.percentile("dx", 0.5).alias("mx"), F.percentile("dy", 0.5).alias("my"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    far = F.sqrt(F.pow(F.col("dx") - F.col("mx"), 2) + F.pow(F.col("dy") - F.col("my"), 2)) > 0.1
    g = p.join(m, ["im1", "im2"]).groupBy("im1", "im2", "n").agg(F.count(F.when(far, 1)).alias("score"))
    return g.where("score >= 0.3 * n and score > 0").select("im1", "im2", "score").orderBy(F.desc("score"), "im1", "im2")


@query(f"""with {_SCENE} select distinct shot_id from images where shot_id is not null and shot_id not in (select shot_id from shots)""")
def remaining_images(spark, d):
    """Images that are in no reconstruction."""
    return table(spark, d, "images").where("shot_id is not null").select("shot_id").subtract(_shots(spark, d).select("shot_id"))


@query(f"""with c as (select sequence_key, avg(e) e, avg(n) n from {scene._POS} where sequence_key is not null group by 1)
  select sequence_key, round(e, 8) e, round(n, 8) n, row_number() over (order by sequence_key) - 1 as label from c""")
def group_centroids(spark, d):
    """Mean position of each group; labels count the groups in order of name."""
    c = scene._positions(spark, d).where("sequence_key is not null").groupBy("sequence_key").agg(F.avg("e").alias("e"), F.avg("n").alias("n"))
    return ranked(c, ["sequence_key"], "label").select("sequence_key", F.round("e", 8).alias("e"), F.round("n", 8).alias("n"), "label")


@query(f"""select 's:' || shot_id a, 't:' || track_id b, feature_id from {scene._OBS}""")
def track_graph(spark, d):
    """The bipartite graph of shots and tracks as edges."""
    return scene._obs(spark, d).select(F.concat(F.lit("s:"), "shot_id").alias("a"), F.concat(F.lit("t:"), "track_id").alias("b"), "feature_id")


_PATTERNS = {"front": r"^g\d*[02468]_", "rear": r"^g\d*[13579]_", "all": r".*"}


@query("""select distinct shot_id, case when regexp_matches(shot_id, '^g\\d*[02468]_.') then 'front' when regexp_matches(shot_id, '^g\\d*[13579]_.') then 'rear' end rig_camera,
  case when regexp_matches(shot_id, '^g\\d*[0-9]_.') then regexp_replace(shot_id, '^g\\d*[0-9]_', '') end instance from images where shot_id is not null""")
def rig_name_patterns(spark, d):
    """Rig camera and instance by the first name pattern that fits; one that takes the whole name fits nothing."""
    return rec.rig_instances(table(spark, d, "images").where("shot_id is not null").select("shot_id").distinct(), "shot_id", _PATTERNS)


@query("""with x as (select vec_id, unnest(embedding::double[]) v, unnest(range(64)) i from embeddings), r as (select vec_id, i, sign(v) * sqrt(abs(v)) s from x)
  select vec_id, i::int i, round(s / sqrt(sum(s * s) over (partition by vec_id)), 6) "value" from r""")
def root_features(spark, d):
    """Signed square roots of descriptors, scaled to length one."""
    root = F.transform("embedding", lambda v: F.signum(v.cast("double")) * F.sqrt(F.abs(v.cast("double"))))
    e = table(spark, d, "embeddings").select("vec_id", root.alias("s"))
    size = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    return e.select("vec_id", size.alias("z"), F.posexplode("s").alias("i", "v")).where("z > 0").select("vec_id", "i", F.round(F.col("v") / F.col("z"), 6).alias("value"))


_WORDS = """(select a.vec_id, w.vec_id word, row_number() over (partition by a.vec_id order by list_distance(a.embedding::double[], w.embedding::double[]), w.vec_id) r
  from embeddings a join embeddings w on w.vec_id % 25 = 7 and a.vec_id <> w.vec_id)"""


def _word_lists(spark, d, k: int) -> DataFrame:
    """The k nearest of the vocabulary (vectors whose ids leave 7 by 25) to each vector."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest_vectors(e, e.where("vec_id % 25 = 7"), "vec_id", "embedding", k)


@query(f"select vec_id, word, r::int rank from {_WORDS} where r <= 2")
def word_assignments(spark, d):
    w = Window.partitionBy("query").orderBy("distance", "other")
    return _word_lists(spark, d, 2).select(F.col("query").alias("vec_id"), F.col("other").alias("word"), F.row_number().over(w).alias("rank"))


@query(f"""with w as (select vec_id, word from {_WORDS} where r <= 2), c as (
    select distinct a.vec_id f1, b.vec_id f2, list_distance(a.embedding::double[], b.embedding::double[]) distance from embeddings a join w wa on wa.vec_id = a.vec_id
    join w wb on wb.word = wa.word join embeddings b on b.vec_id = wb.vec_id where a.label = 0 and b.label = 1),
  s as (select *, row_number() over (partition by f1 order by distance, f2) r, lead(distance) over (partition by f1 order by distance, f2) nxt from c)
  select f1, f2, round(distance, 6) distance from s where r = 1 and (nxt is null or distance < 0.95 * nxt)""")
def words_matches(spark, d):
    """Matches between the vectors of two labels that share one of their two nearest words."""
    words = _word_lists(spark, d, 2).groupBy(F.col("query").alias("vec_id")).agg(F.collect_list("other").alias("words"))
    f = table(spark, d, "embeddings").join(words, "vec_id").select(F.lit(0).alias("pair"), F.col("vec_id").alias("feature"), F.col("embedding").alias("vector"), "words", "label")
    return rec.word_matches(f.where("label = 0"), f.where("label = 1"), 0.95).select("f1", "f2", F.round("distance", 6).alias("distance"))


_COMMON = f"""(select a.shot_id im1, b.shot_id im2, a.feature_id f1, b.feature_id f2, a.x x1, a.y y1, b.x x2, b.y y2 from {scene._GOBS} a join {scene._GOBS} b on a.track_id = b.track_id and a.shot_id < b.shot_id)"""


def _common(spark, d) -> DataFrame:
    o = _tracks(spark, d)
    side = lambda i: o.select("track_id", F.col("shot_id").alias(f"im{i}"), F.col("feature_id").alias(f"f{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    return side(1).join(side(2), "track_id").where("im1 < im2").drop("track_id")


@query(f"""select im1, im2, f1, f2 from (select *, avg((not (pow(x1 - x2, 2) + pow(y1 - y2, 2) >= 0.04))::int) over (partition by im1, im2) share from {_COMMON})
  where share > 0.85 or pow(x1 - x2, 2) + pow(y1 - y2, 2) >= 0.04""")
def moving_matches(spark, d):
    return rec.moving_matches(_common(spark, d), ["im1", "im2"], least2=0.04).select("im1", "im2", "f1", "f2")


_KEPT = f"""(select shot_id image, feature_id, row_number() over (partition by shot_id order by feature_id) - 1 as position from (select distinct shot_id, feature_id from {scene._OBS}) where feature_id % 3 > 0)"""


@query(f"""select m.im1, m.im2, a.feature_id f1, b.feature_id f2 from {scene._NODES} m join {_KEPT} a on a.image = m.im1 and a.position = m.f1 join {_KEPT} b on b.image = m.im2 and b.position = m.f2""")
def unfiltered_matches(spark, d):
    """Feature ids of matches between positions among the features that a mask kept (here ids not divisible by three)."""
    w = Window.partitionBy("shot_id").orderBy("feature_id")
    kept = scene._obs(spark, d).select("shot_id", "feature_id").distinct().where("feature_id % 3 > 0").select(F.col("shot_id").alias("image"), "feature_id", (F.row_number().over(w) - 1).alias("position"))
    m = table(spark, d, "matches").where("im1 is not null and im2 is not null and f1 >= 0 and f2 >= 0").select("im1", "im2", F.col("f1").alias("p1"), F.col("f2").alias("p2")).distinct()
    return rec.unfiltered(m, kept)


@query("""with o as (select distinct id, sqrt(pow(o.projection[1], 2) + pow(o.projection[2], 2)) err, o.shot_id s from (select id, unnest(observations) o from ground_control_points) where id is not null)
  select id, round(sqrt(avg(err * err)), 6) rms, count(*) filter (err > 0.5) n_wrong from o where not isnan(err) group by 1""")
def gcp_errors(spark, d):
    """Per control point the root mean square of its errors and how many exceed one half."""
    o = table(spark, d, "ground_control_points").where("id is not null").select("id", F.explode("observations").alias("o"))
    at = lambda i: F.get("o.projection", F.lit(i))
    o = o.select("id", F.sqrt(at(0) * at(0) + at(1) * at(1)).alias("err"), F.col("o.shot_id").alias("s")).distinct().where("not isnan(err) and err is not null")
    return o.groupBy("id").agg(F.round(F.sqrt(F.avg(F.col("err") * F.col("err"))), 6).alias("rms"), F.count(F.when(F.col("err") > 0.5, 1)).alias("n_wrong"))


@query(f"""with {_SCENE} select part, count(*) n, count(distinct track_id) n_tracks from (
  select 0 part, track_id from points where reconstruction_id < 'g0000010' union all select 1, track_id from points where reconstruction_id >= 'g0000010') group by 1""")
def merged_points(spark, d):
    """Points of two reconstructions under prefixed keys and split again."""
    p = _points(spark, d).select("reconstruction_id", "track_id")
    both = rec.merged([p.where("reconstruction_id < 'g0000010'"), p.where("reconstruction_id >= 'g0000010'")], "track_id")
    return rec.resplit(both, "track_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("track_id").alias("n_tracks"))


@query(f"""select shot_id, feature_id, round("scale", 6) "scale" from (select *, row_number() over (partition by shot_id order by "scale" desc, feature_id) r from (
  select shot_id, feature_id, max("scale") "scale" from {scene._OBS} where "scale" is not null group by 1, 2)) where r <= 5""")
def best_features(spark, d):
    """The five largest features of each shot."""
    f = scene._obs(spark, d).where("scale is not null").groupBy("shot_id", "feature_id").agg(F.max("scale").alias("scale"))
    return rec.best_by_score(f, "shot_id", "feature_id", "scale", 5).select("shot_id", "feature_id", F.round("scale", 6).alias("scale"))


@query(f"""with {_SCENE} select kind, count(*) n_shots, round(avg(width::double * height / 1e6), 6) mean_megapixels from shots group by 1""")
def image_sizes(spark, d):
    """Mean size of the images of each kind of camera."""
    return _shots(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n_shots"), F.round(F.avg(F.col("width").cast("double") * F.col("height") / 1e6), 6).alias("mean_megapixels"))


@query("""select event_type, count(*) n, sum(json_extract(props, '$.k')::bigint)::bigint total from events where props is not null group by 1""")
def event_properties(spark, d):
    """A property of JSON texts, by type."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").where("props is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query("""select distinct shot_id, case when orientation between 1 and 8 then orientation else 1 end orientation from shot_measurements where shot_id is not null""")
def orientations(spark, d):
    """The orientation of each shot, 1 where none is recorded."""
    o = F.when(F.col("orientation").between(1, 8), F.col("orientation")).otherwise(1)
    return table(spark, d, "shot_measurements").where("shot_id is not null").select("shot_id", o.alias("orientation")).distinct()


@query("""select c.camera_id, coalesce(case when k.f > 0 then k.f end, case when c.focal > 0 then c.focal end, 0.85) focal from (select camera_id, max(focal) focal from cameras where camera_id is not null group by 1) c
  left join (select lower(trim(camera_id)) k, 1.0 f from cameras where projection_type = 'spherical' group by 1) k on k.k = lower(trim(c.camera_id))""")
def initial_focals(spark, d):
    """The focal length that a camera starts with: a known calibration, its metadata, or the default."""
    c = table(spark, d, "cameras").where("camera_id is not null")
    key = F.lower(F.trim("camera_id"))
    known = c.where("projection_type = 'spherical'").select(key.alias("k"), F.lit(1.0).alias("f")).distinct()
    c = c.groupBy("camera_id").agg(F.max("focal").alias("focal")).join(known, key == F.col("k"), "left")
    return c.select("camera_id", rec.first_known(F.col("f"), F.col("focal"), F.lit(0.85)).alias("focal"))


@query(f"""with {_SCENE} select shot_id, round((degrees(atan2(sin(heading), cos(heading))) + 360) % 360, 6) compass from shots""")
def shot_compass(spark, d):
    """Compass of the direction that each shot looks along, in order of image."""
    f = F.pmod(F.degrees(F.atan2(F.sin("heading"), F.cos("heading"))) + 360.0, F.lit(360.0))
    return _shots(spark, d).select("shot_id", F.round(f, 6).alias("compass")).orderBy("shot_id")


@query(f"""with {_SCENE}, p as (select a.reconstruction_id, a.track_id, a.shot_id im1, b.shot_id im2, a.cx / a.cz x1, a.cy / a.cz y1, b.cx / b.cz x2, b.cy / b.cz y2
    from cams a join cams b on a.reconstruction_id = b.reconstruction_id and a.track_id = b.track_id and a.shot_id < b.shot_id where a.cz > 0.1 and b.cz > 0.1)
  select im1, im2, count(*) n, count(*) filter (acos(least(greatest((x1 * x2 + y1 * y2 + 1) / sqrt((x1 * x1 + y1 * y1 + 1) * (x2 * x2 + y2 * y2 + 1)), -1), 1)) < 0.2) n_inliers from p group by 1, 2""")
def bearing_inliers(spark, d):
    """Per pair of shots the common points whose rays differ by less than 0.2 radians when the two cameras look alike."""
    p = _projections(spark, d).where("cz > 0.1")
    side = lambda i: p.select("reconstruction_id", "track_id", F.col("shot_id").alias(f"im{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("cx", "cy", "cz")))
    j = side(1).join(side(2), ["reconstruction_id", "track_id"]).where("im1 < im2")
    one = lambda i: [F.col(f"cx{i}") / F.col(f"cz{i}"), F.col(f"cy{i}") / F.col(f"cz{i}"), F.lit(1.0)]
    near = camera.angle_between(one(1), one(2)) < 0.2
    return j.groupBy("im1", "im2").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(near, 1)).alias("n_inliers"))


@query()
def pair_similarities(spark, d):
    """Per pair of images with eight common features or more a robust similarity between them, scored three ways. Sampling has no SQL."""
    tracks = _slim_tracks(spark, d, "x", "y").groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("shot_id", "x", "y"))).alias("seen"))
    # each shot takes the later ones of the track along, so that its own place moves once
    first = tracks.select(F.posexplode("seen").alias("at", "one"), "seen").select(
        F.col("one.shot_id").alias("im1"), F.col("one.x").alias("x1"), F.col("one.y").alias("y1"), F.slice("seen", F.col("at") + 2, F.size("seen")).alias("later")
    )
    common = first.where(F.size("later") > 0).repartition("im1").select("im1", "x1", "y1", F.inline("later").alias("im2", "x2", "y2"))
    return rec.pair_similarities(common, ["im1", "im2"], 8, 0.1, 60)


@query()
def largest_near_component(spark, d):
    """Per sequence the size of the largest set of shots that near neighbours (four within 20 m) link. Components have their own tests."""
    pairs = gps_knn_pairs(spark, d).select(F.xxhash64("im1").alias("u"), F.xxhash64("im2").alias("v"))
    sizes = graph.connected_components(pairs).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    shots = scene._positions(spark, d).select("sequence_key", F.xxhash64("shot_id").alias("label")).distinct()
    return sizes.join(shots, "label").groupBy("sequence_key").agg(F.max("n").alias("n_shots"))


@query(scene.ORACLE["candidate_union"].replace("select im1, im2, max(band) by_order, max(near) by_distance from (", "select distinct im1, im2 from (").replace(" group by 1, 2", "")
       + f" union select least(im1, im2), greatest(im1, im2) from (select *, row_number() over (partition by im1 order by dist, im2) r from {scene._NEAR}) where r <= 4")
def candidate_pairs(spark, d):
    """Distinct candidate pairs of the generators by order, radius and nearest neighbours."""
    knn = gps_knn_pairs(spark, d).select(F.least("im1", "im2").alias("im1"), F.greatest("im1", "im2").alias("im2"))
    return scene.candidate_union(spark, d).select("im1", "im2").unionByName(knn).distinct()
