"""Golden cases of the scene operators, files there and back, kernels, geodesy, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenewright.functions import exif, geo, kernels
from scenewright.operators import graph, observations, retrieval, statistics
from scenewright.plans import catalogue
from scenewright.sources import files
from scenewright.streaming import live


def obs(spark, rows):
    return spark.createDataFrame(rows, "track_id string, shot_id string, feature_id int")


def test_common_and_sub_tracks(spark):
    o = obs(spark, [("1", "1", 1), ("1", "2", 1), ("1", "3", 1), ("2", "1", 2), ("2", "1", 3)])
    assert [tuple(r) for r in observations.common_observations(o, "1", "2").collect()] == [("1", 1, 1)]
    assert observations.common_observations(o, "1", "x").count() == 0
    s = observations.sub_tracks(o, spark.createDataFrame([("1",), ("9",)], "track_id string"), spark.createDataFrame([("2",), ("3",)], "shot_id string"))
    assert {r.shot_id for r in s.collect()} == {"2", "3"}
    assert {tuple(r) for r in observations.covisibility(o).collect()} == {("1", "2", 1), ("1", "3", 1), ("2", "3", 1)}


@pytest.mark.parametrize(
    "a, b, want",
    [([("1", "3"), ("2", "4")], [("1", "4"), ("2", "5")], {("2", "1")}), ([("1", "1")], [("1", "2")], set()), ([("1", "5"), ("2", "6")], [("3", "5"), ("4", "6")], {("1", "3"), ("2", "4")})],
)
def test_corresponding_tracks(spark, a, b, want):
    make = lambda x: obs(spark, [(t, "im", int(f)) for t, f in x])
    assert {tuple(r) for r in observations.corresponding_tracks(make(a), make(b)).collect()} == want


def test_connected_components_by_stars(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7), (200, 200)], "u long, v long")
    got = {r.node: r.label for r in graph.connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 200}


def test_neighbourhood(spark):
    p = spark.createDataFrame([("im0", "im1", 5), ("im1", "im2", 5), ("im2", "im3", 5)], "im1 string, im2 string, n_common long")
    hood = lambda r, m=100: {x.shot_id: x.ring for x in graph.shot_neighbourhood(p, "im2", r, 1, m).collect()}
    assert hood(1) == {"im2": 0, "im1": 1, "im3": 1}
    assert hood(2) == {"im2": 0, "im1": 1, "im3": 1, "im0": 2}


def test_outliers_take_short_tracks_along(spark):
    o = spark.createDataFrame([("a", "1", 0.1), ("a", "2", 9.0), ("b", "1", 0.1), ("c", "1", 9.0), ("c", "2", 0.1), ("c", "3", 0.1)], "track_id string, shot_id string, e double")
    assert {tuple(r)[:2] for r in observations.remove_outliers(o, F.col("e"), 1.0).select("track_id", "shot_id").collect()} == {("b", "1"), ("c", "2"), ("c", "3")}


def test_histogram_edges(spark):
    one = spark.createDataFrame([(2.0,), (2.0,), (None,), (float("nan"),)], "v double")
    got = {r.bin: r.n for r in statistics.equal_width_histogram(one, "v", 4).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0}
    many = np.random.RandomState(0).rand(200).tolist()
    got = [r.n for r in statistics.equal_width_histogram(spark.createDataFrame([(v,) for v in many], "v double"), "v", 10).orderBy("bin").collect()]
    assert got == np.histogram(many, 10)[0].tolist()


def test_geodesy(spark):
    d = spark.createDataFrame([(10.0, 20.0, 30.0), (-42.0, 179.9, 100.0), (89.0, -120.0, 0.0)], "lat double, lon double, alt double")
    e, n, u = geo.topocentric_from_lla("lat", "lon", "alt", F.col("lat") + 0.01, F.col("lon") + 0.01, 5.0)
    d = d.withColumns({"e": e, "n": n, "u": u})
    d = geo.with_lla(d, "e", "n", "u", F.col("lat") + 0.01, F.col("lon") + 0.01, 5.0, ("lat2", "lon2", "alt2"))
    for r in d.collect():
        assert abs(r.lat - r.lat2) < 1e-9 and abs(r.lon - r.lon2) < 1e-8 and abs(r.alt - r.alt2) < 1e-4
    x = spark.range(1).select(geo.chord_metres(F.lit(42.1), F.lit(-11.1), F.lit(0.0), F.lit(42.2), F.lit(-11.3), F.lit(0.0)).alias("d"), *(c.alias(k) for c, k in zip(geo.topocentric_from_lla(F.lit(1e-4), F.lit(1e-4), F.lit(0.0), 0.0, 0.0), "enu"))).first()
    assert 19000 < x.d < 20000 and abs(x.e - 11.131) < 1e-3 and abs(x.n - 11.057) < 1e-3


def test_image_coordinates(spark):
    r = spark.createDataFrame([(10.0, 20.0, 640, 480)], "px double, py double, w int, h int")
    x, y = exif.normalized("px", "py", "w", "h")
    r = r.withColumns({"x": x, "y": y})
    px, py = exif.denormalized("x", "y", "w", "h")
    got = r.select(px.alias("a"), py.alias("b")).first()
    assert abs(got.a - 10) < 1e-9 and abs(got.b - 20) < 1e-9
    assert [round(v, 6) for v in spark.range(1).select(*exif.dms(F.lit(12.5125))).first()] == [12, 30, 45.0]


def test_kernels():
    r = np.random.RandomState(0)
    x = r.rand(80)
    pts = np.stack([x, 3 * x + 2], 1)
    pts[:20, 1] += r.rand(20) * 10 + 1
    line, inside = kernels.fit_line(pts, 0.01)
    assert np.allclose(line, (3, 2)) and inside.sum() == 60
    src = r.rand(50, 3)
    rot = kernels.rotation_from_angle_axis(np.array([0.1, -0.4, 0.3]))
    dst = 2.5 * src @ rot.T + [1, 2, 3]
    dst[:10] += 5
    (scale, got, shift), inside = kernels.fit_similarity(src, dst, 0.01)
    assert abs(scale - 2.5) < 1e-9 and np.allclose(got, rot) and np.allclose(shift, [1, 2, 3]) and inside.sum() == 40
    p = np.array([1.0, 2.0, 10.0])
    c = r.rand(4, 3)
    assert np.allclose(kernels.triangulate_midpoint(c, p - c), p)
    assert kernels.triangulate_midpoint(c[:2], np.array([[0, 0, 1.0], [0, 0, 1.0]])) is None


def test_nearest_vectors(spark):
    r = np.random.RandomState(1)
    v = r.rand(120, 8)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [1.0])], "id long, e array<double>").repartition(3)
    got = {(x.query, x.other) for x in retrieval.nearest_vectors(d.where("id % 50 = 0"), d, "id", "e", 5, block=2).collect()}
    for q in (0, 50, 100):
        dist = np.linalg.norm(v - v[q], axis=1)
        dist[q] = np.inf
        assert {o for a, o in got if a == q} == set(np.argsort(dist)[:5].tolist())


def test_nearest_vectors_given_twice_or_equally_near(spark):
    twice = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in ((1, 0), (2, 1), (2, 1), (3, 3), (3, 3))], "id long, e array<double>").coalesce(1)
    got = {(x.query, x.other, x.distance) for x in retrieval.nearest_vectors(twice, twice, "id", "e", 2).collect()}
    assert got == {(1, 2, 1.0), (1, 3, 3.0), (2, 1, 1.0), (2, 3, 2.0), (3, 2, 2.0), (3, 1, 3.0)}
    ring = spark.createDataFrame([(0, [0.0, 0.0])] + [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(60, 0, -1)], "id long, e array<double>").coalesce(1)
    assert {x.other for x in retrieval.nearest_vectors(ring.where("id = 0"), ring, "id", "e", 3).collect()} == {1, 2, 3}


def test_nearest_histograms_are_exact(spark, monkeypatch):
    from collections import Counter

    r = np.random.RandomState(4)
    texts = {i: [f"w{min(int(r.zipf(1.3)), 900)}" for _ in range(int(r.randint(1, 40)))] for i in range(300)}
    texts[7] = texts[8] = list(texts[9])
    texts[250] = ["alone"]
    rows = [*texts.items()]
    cut = [(20, texts[20][:1]), (20, texts[20][1:])]  # one key in two rows
    df = spark.createDataFrame([x for x in rows if x[0] != 20] + cut + [(None, texts[3]), (None, ["odd", "odd"]), (400, None), (401, [])], "id long, words array<string>").repartition(3)
    freq = Counter(w for t in [*texts.values(), texts[3], ["odd", "odd"]] for w in t)
    total = sum(freq.values())
    raw = {i: {w: n * np.log(total / freq[w]) for w, n in Counter(t).items()} for i, t in texts.items()}
    hist = {i: {w: v / sum(x.values()) for w, v in x.items()} for i, x in raw.items()}
    want = set()
    for q in range(0, 300, 5):
        near = sorted((abs(round(2 - 2 * sum(min(v, hist[o].get(w, 0)) for w, v in hist[q].items()), 9)), o) for o in hist if o != q and hist[o].keys() & hist[q].keys())
        want |= {(q, o, d) for d, o in near[:4]}
    for block, own, shared in ((10_000, 384, 128), (25, 3, 2)):
        monkeypatch.setattr(retrieval, "OWN_COLUMNS", own)
        monkeypatch.setattr(retrieval, "SHARED_COLUMNS", shared)
        got = {(x.query, x.other, round(x.distance, 9)) for x in retrieval.word_neighbours(df, "id", "words", F.expr("id % 5 = 0"), 4, block).collect()}
        assert got == want
    assert retrieval.word_neighbours(df.limit(0), "id", "words", F.expr("id % 5 = 0"), 4).count() == 0
    assert retrieval.word_neighbours(df, "id", "words", F.expr("id = 777"), 4).count() == 0


def test_tracks_file_there_and_back(spark, tmp_path):
    o = spark.createDataFrame([("s1", "1", 3, 0.1, 0.2, 0.004, 1, 2, 3, None, 4), ("s2", "1", 5, 0.3, 0.4, 0.004, 1, 2, 3, 7, None)], files.TRACKS_COLUMNS[2])
    files.write_tracks(o, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_tracks(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, o.collect()))
    (tmp_path / "v0").write_text("a\t1\t2\t0.5\t0.25\t9\t8\t7\n")
    assert tuple(files.read_tracks(spark, str(tmp_path / "v0")).first()) == ("a", "1", 2, 0.5, 0.25, 0.0, 9, 8, 7, None, None)
    (tmp_path / "bad").write_text("a\t1\t2\n")
    with pytest.raises(Exception, match="wrong number of fields"):
        files.read_tracks(spark, str(tmp_path / "bad")).collect()


def test_control_points(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"points": [{"id": "1", "observations": [{"shot_id": "a", "projection": [0.1, 0.2]}]}, {"id": "2", "position": {"latitude": 1.5, "longitude": 2.5}, "observations": []}]}')
    g = files.read_control_points(spark, str(tmp_path / "g.json"))
    files.write_control_points(g, str(tmp_path / "out"))
    assert sorted(map(str, files.read_control_points(spark, str(tmp_path / "out")).collect())) == sorted(map(str, g.collect()))
    (tmp_path / "g.txt").write_text("# note\nWGS84\n13.4 52.5 NaN 10 20 a.jpg\n\n13.4 52.5 NaN 11 21 b.jpg\n13.5 52.5 7 1 2 a.jpg x\n13.5 52.5 7 1 2 zz.jpg\n")
    got = files.read_control_point_list(spark, str(tmp_path / "g.txt"), spark.createDataFrame([("a.jpg",), ("b.jpg",)], "shot_id string")).collect()
    assert sorted((r.x, r.z, r.has_altitude, len(r.observations)) for r in got) == [(13.4, 0.0, False, 2), (13.5, 7.0, True, 1)]


def test_reconstruction_ply_gpx_rig(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"cameras": {"c": {"projection_type": "perspective", "width": 4, "height": 3, "focal": 0.9}}, "shots": {"s1": {"camera": "c", "rotation": [0, 0, 0], "translation": [1, 2, 3]}}, "points": {"7": {"coordinates": [1, 2, 3], "color": [9, 9, 9]}}}]')
    r = files.read_reconstruction(spark, str(tmp_path / "r.json"))
    assert r["shots"].first().translation == [1.0, 2.0, 3.0] and r["points"].first().point_id == "7"
    files.write_reconstruction(r, str(tmp_path / "r2"))
    again = files.read_reconstruction(spark, str(tmp_path / "r2"))
    for k in ("shots", "points", "cameras"):
        assert again[k].collect() == r[k].collect()
    pts = spark.createDataFrame([(1.0, 2.0, 3.0, 0.0, 0.0, 1.0, 1, 2, 3, 4)], ", ".join(f"`{c}` {'double' if i < 6 else 'int'}" for i, c in enumerate(files.PLY_COLUMNS)))
    files.write_ply(pts, str(tmp_path / "p"))
    assert files.read_ply(spark, str(tmp_path / "p")).collect() == pts.collect()
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1.5" lon="2.5"><ele>3</ele><time>2024-01-01T00:00:05Z</time></trkpt><trkpt lat="1.0" lon="2.0"><ele>2</ele><time>2024-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>')
    assert [x.latitude for x in files.read_gpx(spark, str(tmp_path / "t.gpx")).collect()] == [1.0, 1.5]
    (tmp_path / "rig.json").write_text('{"i1": [["a", "left"], ["b", "right"]]}')
    (tmp_path / "old.json").write_text('[[["a", "left"]]]')
    assert files.read_rig_assignments(spark, str(tmp_path / "rig.json")).count() == 2
    assert files.read_rig_assignments(spark, str(tmp_path / "old.json")).first().instance == "0"


def test_stream_equals_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.windowed_counts(s, late="60 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r.start, r.event_type, r.n) for r in rows)
    assert key(spark.table("counts").collect()) == key(live.windowed_counts(e).collect())


def test_every_query_has_a_stable_schema(spark, data):
    for name in ("covisibility_pairs", "p2_found", "resample_dt"):
        df = catalogue.QUERIES[name](spark, data)
        assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
