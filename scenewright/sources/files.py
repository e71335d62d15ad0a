"""Scene file formats as readers and writers: tracks, control points, reconstructions, point clouds, GPS traces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header and columns of each version of a tracks file, and the photo extensions.
TRACKS_HEADER = r"^[A-Z]*_?TRACKS_VERSION_v(\d+)$"
_BASE = "shot_id string, track_id string, feature_id int, x double, y double"
TRACKS_COLUMNS = {
    0: f"{_BASE}, r int, g int, b int",
    1: f"{_BASE}, scale double, r int, g int, b int",
    2: f"{_BASE}, scale double, r int, g int, b int, segmentation_id int, instance_id int",
}
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "pgm", "pnm", "gif")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Observations of a tab-separated tracks file of any version; a line with another number of fields fails the read.

    Version 0 has no header; its scale is 0. Segmentation and instance -1 become null.
    """
    first = spark.read.text(path).limit(1).collect()
    head = first[0].value if first else ""
    known = re.match(TRACKS_HEADER, head)
    version = int(known[1]) if known else 0
    if version not in TRACKS_COLUMNS:
        raise ValueError(f"unknown tracks version: {head}")
    lines = spark.read.text(path).where(F.col("value") != head) if known else spark.read.text(path)
    schema = T.StructType.fromDDL(TRACKS_COLUMNS[version])
    parts = F.split("value", "\t", -1)
    checked = F.when(F.size(parts) == len(schema), parts).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), "value")))
    rows = lines.where("value <> ''").select(checked.alias("p"))
    df = rows.select(*(F.col("p")[i].cast(f.dataType).alias(f.name) for i, f in enumerate(schema)))
    if "scale" not in df.columns:
        df = df.withColumn("scale", F.lit(0.0))
    for c in ("segmentation_id", "instance_id"):
        df = df.withColumn(c, F.nullif(F.col(c), F.lit(-1)) if c in df.columns else F.lit(None).cast("int"))
    return df.select("shot_id", "track_id", "feature_id", "x", "y", "scale", "r", "g", "b", "segmentation_id", "instance_id")


def write_tracks(obs: DataFrame, path: str, prefix: str = "") -> None:
    """The current version of a tracks file: one part that starts with the header, sorted by shot.

    ``prefix`` comes before TRACKS_VERSION_v2 in the header, for programs that expect their own name there.
    """
    cols = [f.name for f in T.StructType.fromDDL(TRACKS_COLUMNS[2])]
    line = F.concat_ws("\t", *(F.coalesce(F.col(c), F.lit(-1)).cast("string") if c in ("segmentation_id", "instance_id") else F.col(c).cast("string") for c in cols))
    body = obs.select(line.alias("value"), F.col("shot_id").alias("s"), F.col("track_id").alias("t"))
    head = obs.sparkSession.createDataFrame([(f"{prefix}TRACKS_VERSION_v2", None, None)], "value string, s string, t string")
    head.unionByName(body).repartition(1).sortWithinPartitions(F.col("s").asc_nulls_first(), "t").select("value").write.mode("overwrite").text(path)


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, image, size of the photos in a folder by extension, in either case; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))
    pattern = r"(?i)\.(" + "|".join(IMAGE_EXTENSIONS) + ")$"
    return f.where(F.col("path").rlike(pattern)).select("path", F.regexp_extract("path", "[^/]+$", 0).alias("image"), "size")


GCP_SCHEMA = "points array<struct<id string, position struct<latitude double, longitude double, altitude double>, observations array<struct<shot_id string, projection array<double>>>>>"


def read_control_points(spark: SparkSession, path: str) -> DataFrame:
    """id, position (may be null), has_altitude, observations of a control point JSON file."""
    points = spark.read.option("multiLine", True).schema(GCP_SCHEMA).json(path).select(F.explode("points").alias("p"))
    return points.select("p.id", "p.position", F.coalesce(F.col("p.position.altitude").isNotNull(), F.lit(False)).alias("has_altitude"), "p.observations")


def write_control_points(points: DataFrame, path: str) -> None:
    """Control points as one JSON document of points; absent positions and altitudes are left out."""
    one = points.select(F.struct("id", "position", "observations").alias("p")).agg(F.sort_array(F.collect_list("p")).alias("points"))
    one.select(F.to_json(F.struct("points")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_control_point_list(spark: SparkSession, path: str, images: DataFrame | None = None) -> DataFrame:
    """projection, id, x, y, z, has_altitude, observations of a text list: a line each of x y z px py image.

    Blank lines and lines from # are skipped and the first other line names the projection. Images not in
    ``images`` (shot_id) are dropped. Lines at one place make one point; a NaN height becomes 0 without altitude.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not value like '#%'")
    first = lines.limit(1).collect()
    if not first:
        return spark.createDataFrame([], "projection string, id string, x double, y double, z double, has_altitude boolean, observations array<struct<shot_id string, projection array<double>>>")
    head = first[0].value
    p = lines.where(F.col("value") != head).select(F.split("value", r"\s+").alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    o = p.select(*(at(i).try_cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "px", "py"))), at(5).alias("shot_id"))
    if images is not None:
        o = o.join(images.select("shot_id").distinct(), "shot_id", "left_semi")
    o = o.withColumns({"has_altitude": ~F.isnan("z"), "z": F.nanvl("z", F.lit(0.0))})
    g = o.groupBy("x", "y", "z", "has_altitude").agg(F.array_sort(F.collect_list(F.struct("shot_id", F.array("px", "py").alias("projection")))).alias("observations"))
    return g.select(F.lit(head).alias("projection"), F.concat_ws(",", "x", "y", "z").alias("id"), "x", "y", "z", "has_altitude", "observations")


_SHOT = "struct<camera string, rotation array<double>, translation array<double>, gps_position array<double>, gps_dop double, orientation int, capture_time double>"
_POINT = "struct<coordinates array<double>, color array<double>>"
_CAMERA = "struct<projection_type string, width int, height int, focal double, k1 double, k2 double>"


def read_reconstruction(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """shots, points, cameras and reference of a reconstruction file, each row with its reconstruction_id."""
    schema = f"cameras map<string, {_CAMERA}>, shots map<string, {_SHOT}>, points map<string, {_POINT}>, reference_lla struct<latitude double, longitude double, altitude double>"
    text = spark.read.option("wholetext", True).text(path)
    all_ = text.select(F.posexplode(F.from_json("value", f"array<struct<{schema.replace('cameras map', 'cameras: map').replace('shots map', 'shots: map').replace('points map', 'points: map').replace('reference_lla struct', 'reference_lla: struct')}>>")).alias("reconstruction_id", "r"))
    out = {}
    for part, key in (("shots", "shot_id"), ("points", "point_id"), ("cameras", "camera_id")):
        e = all_.select("reconstruction_id", F.explode(f"r.{part}").alias(key, "v"))
        out[part] = e.select("reconstruction_id", key, "v.*")
    out["reference"] = all_.select("reconstruction_id", "r.reference_lla.*")
    return out


def write_reconstruction(tables: dict[str, DataFrame], path: str) -> None:
    """The nested document of all reconstructions; each reconstruction's maps are gathered as one record of the file."""
    maps = None
    for part, key in (("cameras", "camera_id"), ("shots", "shot_id"), ("points", "point_id")):
        df = tables[part]
        body = F.struct(*(c for c in df.columns if c not in ("reconstruction_id", key)))
        m = df.groupBy("reconstruction_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), body))).alias(part))
        maps = m if maps is None else maps.join(m, "reconstruction_id", "full")
    one = maps.agg(F.array_sort(F.collect_list(F.struct("reconstruction_id", "cameras", "shots", "points")), lambda a, b: a["reconstruction_id"] - b["reconstruction_id"]).alias("all"))
    one.select(F.to_json(F.transform("all", lambda r: r.dropFields("reconstruction_id"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


PLY_COLUMNS = ["x", "y", "z", "nx", "ny", "nz", "red", "green", "blue", "class"]


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of an ASCII point cloud: the lines of ten numbers; header lines have words."""
    p = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == len(PLY_COLUMNS))
    p = p.where(F.col("p")[0].rlike(r"^[-+0-9.]"))
    return p.select(*(F.col("p")[i].cast("double" if i < 6 else "int").alias(c) for i, c in enumerate(PLY_COLUMNS)))


def write_ply(points: DataFrame, path: str) -> None:
    n = points.count()
    kinds = ["float"] * 6 + ["uchar"] * 4
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *(f"property {k} {c}" for k, c in zip(kinds, PLY_COLUMNS)), "end_header"]
    rows = points.sparkSession.createDataFrame([(i, h) for i, h in enumerate(head)], "i long, value string")
    body = points.select(F.lit(len(head)).cast("long").alias("i"), F.concat_ws(" ", *PLY_COLUMNS).alias("value"))
    rows.unionByName(body).repartition(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def geojson(points: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """One feature a row, as text: a line-delimited feature collection that any number of tasks can write."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """at, latitude, longitude, elevation of all track points, in order of time."""
    schema = "trkseg array<struct<trkpt array<struct<_lat double, _lon double, ele double, time string>>>>"
    t = spark.read.format("xml").option("rowTag", "trk").schema(schema).load(path)
    p = t.select(F.explode("trkseg").alias("s")).select(F.explode("s.trkpt").alias("p"))
    return p.select(F.to_timestamp("p.time").alias("at"), F.col("p._lat").alias("latitude"), F.col("p._lon").alias("longitude"), F.col("p.ele").alias("elevation")).orderBy("at")


def read_rig_assignments(spark: SparkSession, path: str) -> DataFrame:
    """instance, shot_id, rig_camera of a rig file, of the map form or the older list form."""
    text = spark.read.option("wholetext", True).text(path)
    named = F.map_entries(F.from_json("value", "map<string, array<array<string>>>"))
    listed = F.transform(F.from_json("value", "array<array<array<string>>>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    e = text.select(F.explode(F.when(F.trim("value").startswith("["), listed).otherwise(named)).alias("e"))
    return e.select(F.col("e.key").alias("instance"), F.explode("e.value").alias("m")).select("instance", F.col("m")[0].alias("shot_id"), F.col("m")[1].alias("rig_camera"))


def read_image_list(spark: SparkSession, path: str) -> DataFrame:
    """path, image of a list of image files, one a line; blank lines are skipped, and a list without any image fails."""
    lines = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    if not lines.limit(1).count():
        raise OSError(f"no images in {path}")
    return lines.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("image"))


def with_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """``images`` with the path of the mask of each, null where there is none: ``masks`` (path) are named after the image and .png, or listed with their image (image, path)."""
    own = masks if "image" in masks.columns else masks.select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("image"), "path")
    own = own.where("image <> ''").groupBy("image").agg(F.min("path").alias("mask"))
    return images.join(own, "image", "left")


def read_mask_list(spark: SparkSession, path: str) -> DataFrame:
    """image, path of a two-column list of masks."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].alias("image"), F.get(p, F.lit(1)).alias("path")).where("path is not null")


def read_image_groups(spark: SparkSession, path: str) -> DataFrame:
    """image, group of a whitespace-separated list; lines with another number of fields fail the read."""
    p = F.split(F.trim("value"), r"\s+")
    checked = F.when(F.size(p) == 2, p).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), "value")))
    return spark.read.text(path).where("trim(value) <> ''").select(checked.alias("p")).select(F.col("p")[0].alias("image"), F.col("p")[1].alias("group"))


def read_image_positions(spark: SparkSession, path: str) -> DataFrame:
    """image, latitude, longitude of a tab-separated list."""
    return spark.read.csv(path, sep="\t", schema="image string, latitude double, longitude double")


def write_positions_and_compass(shots: DataFrame, path: str) -> None:
    """image, latitude, longitude, altitude, compass as tab-separated lines in order of image; parts follow one another."""
    cols = ["image", "latitude", "longitude", "altitude", "compass"]
    shots.select(*cols).orderBy("image").write.mode("overwrite").csv(path, sep="\t")
