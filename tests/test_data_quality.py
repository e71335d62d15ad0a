"""Problems 1, 2, 4, 5 and 7: brute force, ties, nulls, repeats, empty tables, sources across cuts."""

import tracemalloc
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
from pyspark.sql import functions as F

from scenewright.operators import orphans, proximity, spikes, timestamps, units

MEASURES = "shot_id string, sequence_key string, gps_position array<double>, gps_accuracy double, extra string, field string"


def walk(n, seed, seq="a"):
    r = np.random.RandomState(seed)
    p = np.cumsum(r.normal([3, 1, 0], 1.0, (n, 3)), axis=0)
    return [(f"{seq}{i:05d}", seq, [float(x) for x in p[i]], float(5 + r.rand()), "x", "y") for i in range(n)]


def flagged(spark, rows):
    return {(r.shot_id, r.field_name) for r in spikes.implausible_readings(spark.createDataFrame(rows, MEASURES)).collect()}


def change(rows, i, position=None, accuracy=None):
    a = list(rows[i])
    if position is not None:
        a[2] = position
    if accuracy is not None:
        a[3] = accuracy
    rows[i] = tuple(a)


def test_spikes_in_a_source_across_cuts(spark):
    rows = walk(400, 1)
    clean = flagged(spark, rows)
    assert clean == set()
    want = set()
    for i in (50, 51, 52, 199, 300):
        change(rows, i, [x + d for x, d in zip(rows[i][2], (400.0, -300.0, 0.0))])
        want.add((rows[i][0], "gps_position"))
    for i in (100, 250):
        change(rows, i, accuracy=rows[i][3] * 15)
        want.add((rows[i][0], "gps_accuracy"))
    for i in range(320, 330):
        change(rows, i, rows[320][2], rows[320][3])
        want |= {(rows[i][0], "gps_position"), (rows[i][0], "gps_accuracy")}
    change(rows, 10, [float("nan"), 0.0, 0.0], -1.0)
    change(rows, 20, [9000.0, 0.0, 0.0], 1e9)
    want |= {(rows[i][0], f) for i in (10, 20) for f in ("gps_position", "gps_accuracy")}
    assert flagged(spark, rows + rows[:30]) == want


def test_harmless_readings(spark):
    rows = walk(120, 2)
    for i in range(60, 120):  # a lasting move after a pause
        change(rows, i, [x + 900 for x in rows[i][2]])
    constant = [(f"c{i:03d}", "c", [float(i), 0.0, 0.0], 15.0, "", "") for i in range(40)]
    zero = [(f"z{i:03d}", "z", [float(i), 0.0, 0.0], 0.0 if 10 <= i < 20 else 5 + i / 100, "", "") for i in range(60)]
    nothing = [(f"n{i:03d}", "n", None, None, None, None) for i in range(10)] + [(None, "n", [1.0, 1.0, 1.0], 1.0, "", "")]
    assert flagged(spark, rows + constant + zero + nothing) == set()
    assert flagged(spark, [("s1", None, [1.0, None, 1.0], None, "", ""), ("s2", None, [1.0], 1.0, "", "")]) == {("s1", "gps_position"), ("s2", "gps_position")}
    assert flagged(spark, []) == set()


def test_runs_that_fill_most_of_a_source(spark):
    rows = walk(11, 3, "s")
    for i in range(2, 9):  # seven of eleven
        change(rows, i, rows[2][2], rows[2][3])
    change(rows, 10, rows[9][2], rows[9][3])  # a chance repeat
    long = walk(400, 4, "l")
    for i in range(60, 360):
        change(long, i, long[60][2], long[60][3])
    want = {(r[0], f) for r in rows[2:9] + long[60:360] for f in ("gps_position", "gps_accuracy")}
    constant = [(f"c{i:03d}", "c", [1.0, 2.0, 3.0] if i % 20 else [1.0, 2.0, 4.0 + i], 15.0 if i % 20 else 16.0 + i / 50, "", "") for i in range(100)]
    lone = [(f"d{i:03d}", "d", [1.0, 2.0, 3.0] if i < 29 else [1.0, 2.0, 4.0], 15.0 if i < 29 else 16.0, "", "") for i in range(30)]
    assert flagged(spark, rows + long + constant + lone) == want


def test_low_rank_part_ignores_small_and_large_spikes_alike():
    base = np.outer(np.ones(40), np.linspace(-3, 3, 8))
    m = base + np.random.RandomState(0).normal(0, 0.2, base.shape)
    m[3, 4] += 20
    m[7, 1] += 4000
    hit = np.abs(m - spikes.low_rank_parts([m])[0]) > 4.0
    assert hit[3, 4] and hit[7, 1] and hit.sum() < 12


def test_the_low_rank_part_decides_the_rows_of_the_tables(spark, data, monkeypatch):
    m = spark.read.parquet(f"{data}/shot_measurements.parquet")
    found = {tuple(r) for r in spikes.implausible_readings(m).collect()}
    pdf = spikes.readings(m).toPandas().sort_values(["field", "sequence_key", "shot_id"], ignore_index=True).assign(_core=True)
    rows = lambda: set(spikes.flagged_rows(pdf, {}).itertuples(index=False, name=None))
    assert rows() == found
    # with nothing or everything taken for normal the rows are others
    monkeypatch.setattr(spikes, "low_rank_parts", lambda ms: [x * 0 for x in ms])
    assert rows() != found
    monkeypatch.setattr(spikes, "low_rank_parts", lambda ms: ms)
    assert rows() < found


def test_a_lasting_move_and_a_turn_are_in_the_low_rank_part_and_a_spike_is_not():
    t = np.arange(60.0)
    path = np.stack([np.where(t < 30, t, 60 - t), t / 2, 0 * t], 1) + np.random.RandomState(1).normal(0, 0.3, (60, 3))
    path[45:] += 300.0
    path[20:22] += 40.0
    off = spikes.off_normal([path, path[:9]])
    assert np.flatnonzero(off[0] > 10).tolist() == [20, 21] and off[1].max() < 4 and len(off[1]) == 9


def test_orphans(spark):
    at = lambda d: datetime(2024, 1, d)
    images = spark.createDataFrame(
        [("s1", " C1 ", at(5), None), ("s1", " C1 ", at(9), None), ("s2", "c1", at(25), None), ("s3", "nope", at(5), None), ("s4", "  ", at(5), None), ("s5", None, at(5), None), ("s6", "c2", at(3), at(8)), (None, "c1", at(1), None), ("s7", "c9", None, None)],
        "shot_id string, camera_id string, ingested_at timestamp, deleted_at timestamp",
    )
    cameras = spark.createDataFrame(
        [("c1", at(1), at(10)), ("c1", at(12), at(20)), ("c2", at(4), None)], "camera_id string, created_at timestamp, deleted_at timestamp"
    )
    gcps = spark.createDataFrame(
        [("p1", [("S1", [0.0]), ("s6 ", [0.0]), ("ghost", None), (None, None)], at(9)), ("p1", [("S1", [0.0]), ("s6 ", [0.0]), ("ghost", None), (None, None)], at(30)), ("p2", None, at(1))],
        "id string, observations array<struct<shot_id string, projection array<double>>>, ingested_at timestamp",
    )
    got = {tuple(r) for r in orphans.find_orphans(images, cameras, gcps).collect()}
    assert got == {
        ("images", "s2", "c1", "deleted", "2024-01"),
        ("images", "s3", "nope", "missing", "2024-01"),
        ("images", "s6", "c2", "late", "2024-01"),
        ("images", "s7", "c9", "missing", None),
        ("ground_control_points", "p1", "s6", "deleted", "2024-01"),
        ("ground_control_points", "p1", "ghost", "missing", "2024-01"),
    }
    none = [d.limit(0) for d in (images, cameras, gcps)]
    assert orphans.find_orphans(*none).count() == 0
    assert orphans.find_orphans(images, none[1], none[2]).where("ref_state <> 'missing'").count() == 0


def test_bloom_filter_has_no_false_negatives_even_when_far_too_small(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("ref_key"))
    bits, n = orphans.bloom_filter(keys, "ref_key", max_bytes=1024)
    assert n == 5000 and len(bits) == 128
    assert orphans.with_maybe(keys, "ref_key", bits).where("not _maybe").count() == 0
    wide, _ = orphans.bloom_filter(keys, "ref_key")
    other = spark.range(5000).select(F.concat(F.lit("x"), "id").alias("ref_key"))
    assert orphans.with_maybe(other, "ref_key", wide).where("_maybe").count() < 250


def test_bloom_filter_reaches_the_driver_in_columns(spark):
    keys = spark.range(300_000).select(F.concat(F.lit("k"), "id").alias("ref_key"))
    orphans.bloom_filter(keys.limit(10), "ref_key")  # imports are made before memory is traced
    tracemalloc.start()
    try:
        bits, n = orphans.bloom_filter(keys, "ref_key", max_bytes=800_000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 300_000 and len(bits) == 100_000
    assert peak < 8 * bits.nbytes  # with a Python row for each word it was 54 MB
    word, mask = orphans._word_and_mask(F.col("ref_key"), len(bits))
    want = np.zeros(len(bits), dtype=np.int64)
    for r in keys.select(word.alias("w"), mask.alias("m")).toLocalIterator():
        want[r.w] |= r.m
    assert (bits == want).all()
    none, n = orphans.bloom_filter(keys.limit(0), "ref_key")
    assert n == 0 and not none.any()


TIMES = "shot_id string, sequence_key string, capture_time string, time_zone string"


def instants(spark, rows, zones=(("b", "Europe/Berlin"), ("n", "America/New_York"))):
    z = spark.createDataFrame(list(zones), "sequence_key string, time_zone string")
    return {r.shot_id: r.utc_ms for r in timestamps.capture_instants(spark.createDataFrame(rows, TIMES), z).collect()}


def ms(*a, zone="UTC", fold=0):
    return int(datetime(*a, tzinfo=ZoneInfo(zone), fold=fold).astimezone(timezone.utc).timestamp() * 1000)


READINGS = [
        ("2022-10-29T11:41:09.838Z", ms(2022, 10, 29, 11, 41, 9) + 838),
        ("20221029T114109Z", ms(2022, 10, 29, 11, 41, 9)),
        ("2022:10:29 11:41:09.5-03:30", ms(2022, 10, 29, 15, 11, 9) + 500),
        ("2022-10-29T11:41:09+0530", ms(2022, 10, 29, 6, 11, 9)),
        ("2022:10:29 11:41:09", ms(2022, 10, 29, 11, 41, 9, zone="Europe/Berlin")),
        ("2022-10-29 11:41:09 Pacific/Fiji", ms(2022, 10, 29, 11, 41, 9, zone="Pacific/Fiji")),
        ("29 Oct 2022 11:41:09 GMT+05:45", ms(2022, 10, 29, 5, 56, 9)),
        ("29/10/2022 12:41:09 AM", ms(2022, 10, 29, 0, 41, 9, zone="Europe/Berlin")),
        ("10/29/2022 12:41:09 PM", ms(2022, 10, 29, 12, 41, 9, zone="Europe/Berlin")),
        ("1667043669838", 1667043669838),
        ("1667043669.8389", 1667043669838),
        ("1667043669838999", 1667043669838),
        ("1.667043669838E9", 1667043669838),
        ("2022-03-27 02:30:00", None),  # skipped by the clock change
        ("2022:02:30 10:00:00", None),
        ("2022-13-04 08:00:00", None),
        ("1970:01:01 00:00:00", None),
        ("0000:00:00 00:00:00", None),
        ("2022-10-29 11:41:09 Mars/Base", None),
        ("0", None),
        ("", None),
        ("n/a", None),
        (None, None),
]


def test_readings_of_one_text(spark):
    rows = [(f"s{i}", f"b{i}", text, "clash") for i, (text, _) in enumerate(READINGS)]
    got = instants(spark, rows, [(f"b{i}", "Europe/Berlin") for i in range(len(rows))])
    assert got == {f"s{i}": want for i, (_, want) in enumerate(READINGS) if want is not None}


def test_order_settles_twice_shown_times_and_day_month_order(spark):
    local = ["01:58:00", "02:10:00", "02:50:00", "02:05:00", "02:40:00", "03:01:00"]
    rows = [(f"b{i}", "b", f"2022-10-30 {t}", "") for i, t in enumerate(local)]
    got = instants(spark, rows + rows)
    folds = [0, 0, 0, 1, 1, 0]
    assert got == {f"b{i}": ms(2022, 10, 30, *map(int, t.split(":")), zone="Europe/Berlin", fold=f) for i, (t, f) in enumerate(zip(local, folds))}
    rows = [("n1", "n", "05/06/2022 10:00:00 AM", ""), ("n2", "n", "05/06/2022 11:00:00 AM", ""), ("n3", "n", "05/25/2022 11:00:00 AM", "")]
    assert instants(spark, rows)["n1"] == ms(2022, 5, 6, 10, zone="America/New_York")
    rows = [("n1", "n", "05/06/2022 10:00:00 AM", ""), ("n2", "n", "2022-06-05T15:00:00Z", "")]
    assert instants(spark, rows)["n1"] == ms(2022, 6, 5, 10, zone="America/New_York")


def test_one_source_across_many_partitions(spark):
    start = ms(2022, 10, 29, 22) // 1000
    rows, want = [], {}
    for i in range(600):
        t = start + i * 40
        here = datetime.fromtimestamp(t, ZoneInfo("Europe/Berlin"))
        rows.append((f"s{i:05d}", "b", here.strftime("%d/%m/%Y %I:%M:%S %p" if i % 3 else "%Y-%m-%d %H:%M:%S"), ""))
        want[f"s{i:05d}"] = t * 1000
    assert instants(spark, rows) == want
    assert instants(spark, []) == {}
    assert instants(spark, [("a", None, "2022-10-29 11:00:00", "")]) == {"a": ms(2022, 10, 29, 11)}


def test_near_pairs_against_brute_force(spark):
    r = np.random.RandomState(3)
    spots = [(0.0, 179.9999), (70.0, 15.0), (89.99995, 10.0), (-42.0, 171.0), (89.99995, -170.0)]
    pts = [(f"p{i}", spots[i % 5][0] + r.normal(0, 3e-4), spots[i % 5][1] + r.normal(0, 3e-4)) for i in range(400)]
    pts = [(i, min(a, 90.0), (b + 180) % 360 - 180) for i, a, b in pts]
    left = pts[:100] + [("null", None, 1.0), (None, 1.0, 1.0), ("far", float("nan"), 0.0), ("bad", 95.0, 0.0)]
    x = proximity._xyz(np.array([p[1] for p in pts]), np.array([p[2] for p in pts]))
    want = {(pts[i][0], pts[j][0]) for i in range(100) for j in range(400) if np.linalg.norm(x[i] - x[j]) <= 30}
    make = lambda p: spark.createDataFrame(p, "id string, lat double, lon double").withColumn("strip", F.lit(1))
    for rows in (50_000, 7):
        got = {tuple(q) for q in proximity.near_pairs(make(left + left[:5]), make(pts), 30.0, strip_rows=rows).collect()}
        assert got == want and len(want) > 400
    assert proximity.near_pairs(make([]), make(pts), 30.0).count() == 0


EXIF = "shot_id string, writer string, width string, height int, focal_ratio string, unit string"


UNITS = [
        ("97", "677.333 mm at 150 dpi", "percent", (970, 4000)),
        ("16,52mm", "2 048 px", "percent", (459, 2048)),
        ("93.49mm (35mm equiv.)", "6,000 Kilopixel", "percent", (2597, 6000)),
        ("0.6591 in (35 mm eq.)", "2048 × 1536 pixels", "percent", (465, 2048)),
        ("10.113 mm / sensor 10.77 mm", "2.048e3 px", "percent", (939, 2048)),
        ("6144.8 px", "4032", "percent", (1524, None)),
        ("f=1.627 cm", "10.0000 in @ 600 dpi", "percent", (452, 6000)),
        ("1013/1000", "-1", "percent", (1013, None)),
        ("101,3%", "n/a", "percent", (1013, None)),
        ("4455.6", "2.592", "pixels", (1719, 2592)),
        ("4455.6", None, "pixels", (None, None)),
        ("0.0", "0", "pixels", (None, None)),
        ("1.5", "17.3397", "print", (None, 2048)),
        ("unknown", "", "print", (None, None)),
        (None, None, None, (None, None)),
]


def test_units(spark):
    notes = [("percent", "Brennweite in Prozent der Sensorbreite, Bildbreite in Pixel."), ("pixels", "focal: pixels of the frame width; width: thousands of pixels"), ("print", "Focal as ratio to sensor width. Width as printed, centimetres at 300 dots per inch."), (None, "x")]
    e = spark.createDataFrame([(f"s{i}", writer, width, None, focal, "u") for i, (focal, width, writer, _) in enumerate(UNITS)] * 2, EXIF)
    got = {(r.shot_id, r.field_name): r.common_value for r in units.common_units(e, spark.createDataFrame(notes, "writer string, note string")).collect()}
    for i, case in enumerate(UNITS):
        assert (got.get((f"s{i}", "focal_ratio")), got.get((f"s{i}", "width"))) == case[3], case
    assert units.common_units(e.limit(0), spark.createDataFrame(notes, "writer string, note string")).count() == 0


def test_identities_choose_units_without_a_note(spark):
    notes = spark.createDataFrame([("w", None)], "writer string, note string")
    e = spark.createDataFrame([("s", "w", "2.048", 1536, "98.5", ""), ("t", "w", "4000", None, "1.5", "")], EXIF)
    got = {(r.shot_id, r.field_name): r.common_value for r in units.common_units(e, notes).collect()}
    assert got[("s", "width")] == 2048 and ("t", "width") not in got
    # per cent of the width and millimetres of a 35 mm lens are both real lenses here
    assert units.resolved_units(e, notes).where("ambiguous and shot_id = 's'").count() == 1


def test_identities_alone_choose_the_units_of_all_writers_of_the_tables(spark, data, monkeypatch):
    exif, writers = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("exif", "exif_writers"))
    rows = lambda w: {tuple(r) for r in units.common_units(exif, w).collect()}
    told = rows(writers)
    # of the notes only the resolution is left, which no identity gives
    dots = F.regexp_extract("note", "([0-9]+) dots per inch", 1)
    unit = F.when(F.col("note").contains("centimetres"), "centimetres").otherwise("inches")
    silent = writers.withColumn("note", F.when(dots != "", F.concat(F.lit("Width: "), unit, F.lit(" at "), dots, F.lit(" dots per inch"))))
    assert len(told) > 200 and rows(silent) == told
    # notes that tell the wrong unit don't change what the identities tell
    wrong = writers.withColumn("note", F.when(dots == "", "Focal in percent. Width in thousands of pixels.").otherwise(F.col("note")))
    assert rows(wrong) == told
    # without the identities of writers' records, notes don't decide, and ranges of single records often go wrong
    monkeypatch.setattr(units, "CAP", 0.0)
    assert len(rows(writers) & told) < 0.8 * len(told)


def test_the_last_sign_of_a_number_is_the_decimal_one():
    assert units.read_width("1.234,5 px")[0] == 1234.5 and units.read_width("1,234.5 px")[0] == 1234.5
    assert units.read_focal("1.013,5 ‰")[0] == 1.0135
    assert np.isnan(units.read_width("17.3 cm at  dpi")).all() and np.isnan(units.read_width("")).all() and np.isnan(units.read_focal(None)).all()


def test_a_switch_of_date_format_costs_and_the_other_rows_settle_it(spark):
    rows = [("n1", "n", "05/06/2022 10:00:00 AM", ""), ("n2", "n", "06/06/2022 10:00:00 AM", ""), ("n3", "n", "13/06/2022 10:00:00 AM", ""), ("n4", "n", "2022-06-14T15:00:00Z", "")]
    got = instants(spark, rows)
    assert [got[f"n{i}"] for i in (1, 2, 3)] == [ms(2022, 6, d, 10, zone="America/New_York") for d in (5, 6, 13)]
    # a date that only the other order reads names no instant when the rest of the group speaks against it
    rows += [(f"n5{i}", "n", f"{15 + i}/06/2022 10:00:00 AM", "") for i in range(3)] + [("n9", "n", "06/25/2022 10:00:00 AM", "")]
    got = instants(spark, rows)
    assert "n9" not in got and got["n1"] == ms(2022, 6, 5, 10, zone="America/New_York")
