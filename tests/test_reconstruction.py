"""Cameras, reconstructions, components and the registered queries of the core."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenewright import runtime
from scenewright.functions import camera, kernels
from scenewright.operators import graph, retrieval
from scenewright.operators import reconstruction as rec
from scenewright.plans import catalogue
from scenewright.sources import files


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_every_query_runs_and_names_what_its_sql_names(spark, data, name):
    import os

    import duckdb

    df = catalogue.QUERIES[name](spark, data)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in catalogue.ORACLE:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
        want = con.sql(catalogue.ORACLE[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert len(want.fetchall()) == len(rows)


def test_rays_undo_projections(spark):
    kinds = ["perspective", "simple_radial", "radial", "brown", "fisheye", "spherical"]
    rows = [(k, 0.3 * i - 0.6, 0.2 * j - 0.4, 1.5) for k in kinds for i in range(5) for j in range(5)]
    df = spark.createDataFrame(rows, "kind string, x double, y double, z double")
    u, v = camera.projected("kind", "x", "y", "z", 0.9, -0.05, 0.01)
    back = camera.ray("kind", "u", "v", 0.9, -0.05, 0.01)
    got = df.withColumns({"u": u, "v": v}).where("u is not null").withColumn("r", back).toPandas()
    want = got[["x", "y", "z"]].to_numpy()
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert len(got) > 140 and np.abs(np.stack(got["r"]) - want).max() < 1e-9
    behind = spark.createDataFrame([("perspective", 0.0, 0.0, -1.0), ("odd", 0.0, 0.0, 1.0), (None, 0.0, 0.0, 1.0), ("fisheye", None, 0.0, 1.0)], "kind string, x double, y double, z double")
    assert behind.select(u.alias("u")).where("u is not null").count() == 0


def test_triangulation_gates(spark):
    r = np.random.RandomState(0)
    rays = []
    for t in range(20):
        p = r.normal(0, 5, 3) + [0, 0, 30]
        for _ in range(4):
            o = r.normal(0, 3, 3)
            rays.append((f"t{t}", *map(float, o), *map(float, (p - o) * 0.5), *map(float, p)))
    rays += [("parallel", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), ("parallel", 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), ("lone", 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)]
    rays += [("back", 0.0, 0.0, 0.0, 0.0, 0.1, -1.0, 0.0, 0.0, 0.0), ("back", 1.0, 0.0, 0.0, 0.1, 0.1, -1.0, 0.0, 0.0, 0.0), ("none", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rays, "track_id string, ox double, oy double, oz double, bx double, by double, bz double, wx double, wy double, wz double")
    got = rec.triangulated(df, ["track_id"], max_error=0.01).join(df.select("track_id", "wx", "wy", "wz").distinct(), "track_id").toPandas()
    assert sorted(got["track_id"]) == sorted(f"t{t}" for t in range(20))
    assert np.abs(got[["x", "y", "z"]].to_numpy() - got[["wx", "wy", "wz"]].to_numpy()).max() < 1e-6
    one = [tuple(map(float, rays[i][1:4])) for i in range(4)]
    assert np.allclose(kernels.triangulate_midpoint(np.array(one), np.array([rays[i][4:7] for i in range(4)])), rays[0][7:])
    assert rec.triangulated(df.limit(0), ["track_id"]).count() == 0


def test_name_patterns_masks_and_prefixes(spark):
    images = spark.createDataFrame([("rig1_left_07.jpg",), ("rig1_right_07.jpg",), ("left_",), ("other.jpg",), (None,)], "image string")
    got = {x.image: (x.rig_camera, x.instance) for x in rec.rig_instances(images, "image", {"left": "left_", "right": "right_"}).collect()}
    assert got == {"rig1_left_07.jpg": ("left", "rig1_07.jpg"), "rig1_right_07.jpg": ("right", "rig1_07.jpg"), "left_": (None, None), "other.jpg": (None, None), None: (None, None)}
    kept = spark.createDataFrame([("a", i, f) for i, f in enumerate((3, 5, 7))] + [("b", i, f) for i, f in enumerate((4, 6, 8))], "image string, position int, feature_id int")
    m = spark.createDataFrame([("a", "b", 0, 2), ("a", "b", 2, 1), ("a", "b", 9, 1)], "im1 string, im2 string, p1 int, p2 int")
    assert {(x.f1, x.f2) for x in rec.unfiltered(m, kept).collect()} == {(3, 8), (7, 6)}
    parts = [spark.createDataFrame([("x_R1_",), ("y",)], "k string"), spark.createDataFrame([("x_R1_",), ("",)], "k string")]
    assert {(x.part, x.k) for x in rec.resplit(rec.merged(parts, "k"), "k").collect()} == {(0, "x_R1_"), (0, "y"), (1, "x_R1_"), (1, "")}
    still = [("p", "q", 0.1, 0.1, 0.1, 0.1)] * 9
    df = lambda rows: spark.createDataFrame(rows, "im1 string, im2 string, x1 double, y1 double, x2 double, y2 double")
    assert rec.moving_matches(df(still + [("p", "q", 0.1, 0.1, 0.5, 0.1)]), ["im1", "im2"]).count() == 10
    assert rec.moving_matches(df(still[:2] + [("p", "q", 0.1, 0.1, 0.5, 0.1)]), ["im1", "im2"]).count() == 1


def test_word_matches_let_single_candidates_pass(spark):
    f = lambda rows: spark.createDataFrame([(0, i, v, w) for i, v, w in rows], "pair int, feature int, vector array<double>, words array<int>")
    first = f([(1, [0.0, 0.0], [5]), (2, [1.0, 1.0], [6, 7]), (3, [9.0, 9.0], [8]), (4, [0.0, 0.0], None)])
    second = f([(11, [0.0, 0.1], [5]), (12, [1.0, 1.2], [6]), (13, [1.0, 1.21], [7]), (14, [1.0, 1.0], [9])])
    assert {(x.f1, x.f2) for x in rec.word_matches(first, second, 0.8).collect()} == {(1, 11)}


def test_ranks_over_partitions_and_components_of_numbers(spark):
    df = spark.createDataFrame([(f"k{i:04d}",) for i in np.random.RandomState(1).permutation(500)], "k string")
    got = runtime.ranked(df, ["k"]).toPandas().sort_values("k")
    assert got["rank"].tolist() == list(range(500))
    assert runtime.ranked(df.limit(0), ["k"]).count() == 0
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (300, 300), (5, 3), (5, 3)]
    e = spark.createDataFrame(edges, "u long, v long").repartition(6)
    want = {i: 0 for i in range(101)} | {200: 200, 201: 200, 300: 300}
    for most in (0, 1_000_000):
        assert {x.node: x.label for x in graph.connected_components(e, most).collect()} == want
    named = e.select(F.concat(F.lit("n"), "u").alias("u"), F.concat(F.lit("n"), "v").alias("v"))
    assert {(x.node, x.label) for x in graph.connected_components(named).collect()} == {(f"n{k}", f"n{v}") for k, v in want.items()}
    assert graph.connected_components(e.limit(0)).count() == 0


def test_scores_of_robust_models():
    e = np.array([0.0, 0.01, 0.02, 5.0])
    s = kernels.scores(e, 0.1)
    assert s["ransac"] == 3 and s["msac"] == pytest.approx(1 / (0.0005 + 0.01 + 1e-8)) and s["lmeds"] == pytest.approx(1 / (0.015 + 1e-8))
    assert kernels.scores(np.array([np.inf]), 0.1)["msac"] == 0.0


def test_lists_of_images_masks_groups_and_positions(spark, tmp_path):
    (tmp_path / "images.txt").write_text("a/x.jpg\n\n b/y.JPG \n")
    images = files.read_image_list(spark, str(tmp_path / "images.txt"))
    assert {tuple(r) for r in images.collect()} == {("a/x.jpg", "x.jpg"), ("b/y.JPG", "y.JPG")}
    (tmp_path / "none.txt").write_text("\n")
    with pytest.raises(OSError):
        files.read_image_list(spark, str(tmp_path / "none.txt"))
    masks = spark.createDataFrame([("m/x.jpg.png",), ("m/other.png",)], "path string")
    assert {(r.image, r["mask"]) for r in files.with_masks(images, masks).collect()} == {("x.jpg", "m/x.jpg.png"), ("y.JPG", None)}
    (tmp_path / "masks.txt").write_text("y.JPG m/any.png\nlone\n")
    listed = files.with_masks(images, files.read_mask_list(spark, str(tmp_path / "masks.txt")))
    assert {(r.image, r["mask"]) for r in listed.collect()} == {("x.jpg", None), ("y.JPG", "m/any.png")}
    (tmp_path / "groups.txt").write_text("x.jpg  g1\ny.JPG\tg2\n")
    assert {tuple(r) for r in files.read_image_groups(spark, str(tmp_path / "groups.txt")).collect()} == {("x.jpg", "g1"), ("y.JPG", "g2")}
    shots = spark.createDataFrame([("y", 1.5, 2.5, 3.0, 90.0), ("x", 0.5, None, 1.0, 0.0)], "image string, latitude double, longitude double, altitude double, compass double")
    files.write_positions_and_compass(shots, str(tmp_path / "compass"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "compass").glob("part*")))
    assert text.splitlines() == ["x\t0.5\t\t1.0\t0.0", "y\t1.5\t2.5\t3.0\t90.0"]
    files.write_positions_and_compass(shots.limit(0), str(tmp_path / "empty"))
    (tmp_path / "gps.tsv").write_text("x.jpg\t47.5\t-6.25\n")
    assert [tuple(r) for r in files.read_image_positions(spark, str(tmp_path / "gps.tsv")).collect()] == [("x.jpg", 47.5, -6.25)]


def test_distances_to_the_nearest_points_across_leaves(spark):
    r = np.random.RandomState(3)
    v = np.concatenate([r.normal(0, 1, (700, 3)), r.normal(40, 5, (200, 3)), np.repeat([[0.5, 0.5, 0.5]], 150, 0), r.uniform(-3000, 3000, (20, 3))])
    rows = [(f"k{i:04d}", *map(float, x)) for i, x in enumerate(v)]
    odd = [("none", None, 0.0, 0.0), ("nan", float("nan"), 0.0, 0.0), ("inf", 0.0, float("inf"), 0.0), (None, 0.0, 0.0, 0.0), rows[5]]
    df = spark.createDataFrame(rows + odd, "k string, x double, y double, z double").repartition(3)
    d = np.sqrt(((v[:, None] - v) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, 1)[:, :3]
    for leaf in (60, 100_000):
        got = {x.k: x.distances for x in retrieval.nearest_distances(df, "k", ["x", "y", "z"], 3, leaf).collect()}
        assert len(got) == len(rows)
        assert np.allclose([got[k[0]] for k in rows], want, rtol=1e-12, atol=0)
    few = {x.k: x.distances for x in retrieval.nearest_distances(df.where("k in ('k0001', 'k0002')"), "k", ["x", "y", "z"], 3).collect()}
    assert [len(few[k]) for k in ("k0001", "k0002")] == [1, 1]
    assert retrieval.nearest_distances(df.limit(0), "k", ["x", "y", "z"], 3).count() == 0


def test_similarities_of_many_pairs_at_once(spark):
    r = np.random.RandomState(5)
    rows, want = [], {}
    for p in range(60):
        n = int(r.randint(6, 20))
        a = r.uniform(-0.5, 0.5, (n, 2))
        b = 1.3 * a @ np.array([[0.8, -0.6], [0.6, 0.8]]).T + [0.1, 0.2] + r.normal(0, 0.02, (n, 2))
        b[: n // 3] += r.normal(0, 2, (n // 3, 2))
        order = np.lexsort(a.T[::-1])
        a, b = a[order], b[order]
        rows += [("a", f"b{p}", i, i, *map(float, a[i]), *map(float, b[i])) for i in range(n)]
        if n >= 8:
            model, inside = kernels.fit_similarity(a, b, 0.1, rounds=60)
            s = kernels.scores(np.linalg.norm(model[0] * a @ model[1].T + model[2] - b, axis=1), 0.1)
            want[f"b{p}"] = (n, int(inside.sum()), s["msac"], s["lmeds"])
    rows += [("a", "nan", i, i, float("nan"), 0.0, 0.0, 0.0) for i in range(8)]
    df = spark.createDataFrame(rows, "im1 string, im2 string, f1 int, f2 int, x1 double, y1 double, x2 double, y2 double")
    for parts in (1, 7):  # in whichever order the rows come
        got = {x.im2: tuple(x)[2:] for x in rec.pair_similarities(df.orderBy(F.rand(parts)).repartition(parts), ["im1", "im2"], 8, 0.1, 60).collect()}
        assert got.pop("nan") == (8, 0, 0.0, 0.0)
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k] == pytest.approx(v, rel=1e-9)
    assert rec.pair_similarities(df.limit(0), ["im1", "im2"], 8, 0.1, 60).count() == 0
