"""Quantities in different units: candidate units per writer, combinations judged by physical identities.

Identities used: width over height in pixels is one of the usual aspect ratios; records of one camera model
and frame height agree in the ratio of focal length to sensor width; a focal length in pixels over the width
in pixels is that ratio; ratios and widths lie in the range of real cameras. A writer uses one unit for the
numbers that carry none, so its residuals are summed over all its records. Texts are read, and the unit of a record is
chosen, in Arrow batches: as column expressions both are too long for the JVM to compile, and took ten times the CPU time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, written

# Aspect ratios of sensors, plausible focal ratios and widths, the width of a 35 mm frame.
ASPECTS = [4 / 3, 3 / 2, 16 / 9, 2.0, 1.0, 5 / 4]
FOCAL_RANGE, WIDTH_RANGE = (0.2, 6.0), (300.0, 60_000.0)
FRAME_MM = 36.0
_INCH = {"mm": 25.4, "cm": 2.54, "in": 1.0}

#: Units of a number without one, the more usual first.
WIDTH_UNITS = ["px", "kpx", "mm", "cm", "in"]
FOCAL_UNITS = ["ratio", "percent", "permille", "px", "eq_mm", "eq_cm", "eq_in"]

#: Where the log residual of one identity is cut off, so that no single record outweighs the others; mean
#: residuals closer than ``MARGIN`` are not told apart; a record this far off under its writer's unit is judged alone.
CAP, MARGIN, ALONE = 1.0, 0.05, 1.0
#: Width, in logarithms, of the classes in which two focal ratios agree.
AGREE = 0.002

_NUM = r"([0-9][0-9\s.,]*(?:[eE][+-]?[0-9]+)?)"
_WIDTH = re.compile(rf"\s*\+?{_NUM}(?:\s*[x×*]\s*{_NUM})?\s*(px|pixels?|kpx|kilopixels?|k px|mm|cm|in)?\.?\s*(?:(?:at|@)\s*([0-9.]+)\s*dpi)?\s*", re.I)
_FOCAL = re.compile(rf"\s*\+?(ratio\s*[:=]?|f\s*=)?\s*{_NUM}\s*(mm|cm|in|%|‰|px|pixels?)?\.?\s*(?:/\s*(?:sensor\s*)?{_NUM}\s*(mm|cm|in)?\s*)?(?:\(.*\))?\s*", re.I)
_PLAIN = re.compile(r"\s*\+?[0-9]+(\.[0-9]*)?\s*")
_MM = {"mm": 1.0, "cm": 10.0, "in": 25.4}
_WIDTH_WORD = r"(?i)^(.*)(width|breite|largeur|ancho|anchura)(.*)$"


def note_units(note: Column) -> tuple[Column, Column]:
    """(unit of the focal value, unit of the width) that a writer's note names; null where it names none.

    Width units are px, kpx, or mm, cm or in with dots per inch after an @; focal units ratio, percent,
    permille, px, eq_mm, eq_cm or eq_in. The last word for width opens the clause on width.
    """
    note = F.regexp_replace(note, r"\s+", " ")
    focal = F.when(note.rlike(_WIDTH_WORD), F.regexp_extract(note, _WIDTH_WORD, 1)).otherwise(note)
    width = F.when(note.rlike(_WIDTH_WORD), F.regexp_extract(note, _WIDTH_WORD, 3))
    dpi = F.regexp_extract(width, r"(?i)([0-9]+)\s*(dots|dpi|punkte|points|ppp)", 1)
    wide = (
        F.when(width.rlike(r"(?i)inch|\bin\b.*(dots|dpi)|zoll|pouce") & ~width.rlike(r"(?i)centim|\bcm\b|millim|\bmm\b") & (dpi != ""), F.concat(F.lit("in@"), dpi))
        .when(width.rlike(r"(?i)centim|zentim|\bcm\b") & (dpi != ""), F.concat(F.lit("cm@"), dpi))
        .when(width.rlike(r"(?i)millim|\bmm\b") & (dpi != ""), F.concat(F.lit("mm@"), dpi))
        .when(width.rlike(r"(?i)kilopixel|thousand|tausend|millier|\bkpx\b|\bmiles\b"), "kpx")
        .when(width.rlike(r"(?i)pixel|\bpx\b|píxel"), "px")
    )
    far = (
        F.when(focal.rlike(r"(?i)35\s*-?mm"), F.when(focal.rlike(r"(?i)\bcm\b|centim"), "eq_cm").when(focal.rlike(r"(?i)inch"), "eq_in").otherwise("eq_mm"))
        .when(focal.rlike(r"(?i)percent|prozent|pour ?cent|por ciento|%"), "percent")
        .when(focal.rlike(r"(?i)millimes|promille|per mille|permille|thousandth|tausendstel|‰"), "permille")
        .when(focal.rlike(r"(?i)pixel|\bpx\b|píxel"), "px")
        .when(focal.rlike(r"(?i)ratio|over|normali|rapport|by sensor|verh|relaci"), "ratio")
    )
    return far, wide


def _number(text: str) -> float:
    """The value of digits with a decimal point or comma, spaces or the other sign between thousands, or an exponent."""
    t = "".join(text.split())
    if "," in t and "." in t:
        t = t.replace(".", "").replace(",", ".") if t.rindex(",") > t.rindex(".") else t.replace(",", "")
    try:
        return float(t.replace(",", "."))
    except ValueError:
        return math.nan


def read_width(text: str | None) -> tuple[float, float, float]:
    """(pixels of a width that carries its unit, another reading of it, the number of one that carries none); NaN for what it is not."""
    nan = math.nan
    m = _WIDTH.fullmatch(text) if text else None
    if not m:
        return nan, nan, nan
    n, unit = _number(m[1]), (m[3] or "").lower()
    pixels = unit in ("px", "pixel", "pixels")
    if m[2]:
        return (n if (pixels or not unit) and not m[4] else nan), nan, nan
    if unit in _MM:
        return (n / _INCH[unit] * _number(m[4]) if m[4] else nan), nan, nan
    if m[4]:
        return nan, nan, nan
    if pixels:
        return n, (_number(m[1].replace(",", "")) if "," in m[1] else nan), nan
    if unit:
        return n * 1000, nan, nan
    return nan, nan, (n if _PLAIN.fullmatch(text) else nan)


def read_focal(text: str | None) -> tuple[float, float, float]:
    """(focal ratio of a value that carries its unit, pixels of one in pixels, the number of one that carries none); NaN for what it is not."""
    nan = math.nan
    m = _FOCAL.fullmatch(text) if text else None
    if not m:
        return nan, nan, nan
    n, unit, prefix = _number(m[2]), (m[3] or "").lower(), (m[1] or "").lower()
    if m[4]:
        below = _number(m[4]) * (_MM[m[5].lower()] if m[5] else 1.0)
        fits = unit in _MM if m[5] else not unit and not prefix
        return (n * _MM.get(unit, 1.0) / below if fits and below else nan), nan, nan
    if unit in _MM:
        return n * _MM[unit] / FRAME_MM, nan, nan
    if unit in ("%", "‰"):
        return (n / (100 if unit == "%" else 1000) if not prefix else nan), nan, nan
    if unit:
        return nan, (n if not prefix else nan), nan
    if prefix:
        return (n if prefix.startswith("ratio") else nan), nan, nan
    return nan, nan, (n if _PLAIN.fullmatch(text) else nan)


def parsed_values(rows: DataFrame) -> DataFrame:
    """``rows`` with w_px, w_alt, w_plain of :func:`read_width` and f_ratio, f_px, f_plain of :func:`read_focal`; null where not positive."""

    @F.pandas_udf("w_px double, w_alt double, w_plain double, f_ratio double, f_px double, f_plain double")
    def read(width: pd.Series, focal: pd.Series) -> pd.DataFrame:
        parts = []
        for values, reader in ((width, read_width), (focal, read_focal)):
            code, texts = pd.factorize(values, use_na_sentinel=True)
            parts.append(np.array([*map(reader, texts), (math.nan,) * 3])[code])
        out = np.concatenate(parts, axis=1)
        with np.errstate(invalid="ignore"):
            out[~((out > 0) & np.isfinite(out))] = math.nan
        # Arrow turns the NaN of a pandas column into null
        return pd.DataFrame(out, columns=["w_px", "w_alt", "w_plain", "f_ratio", "f_px", "f_plain"])

    return rows.withColumn("_r", read("width", "focal_ratio")).select(*rows.columns, "_r.*")


def _outside(log, bounds: tuple[float, float]):
    return np.maximum(0.0, np.maximum(math.log(bounds[0]) - log, log - math.log(bounds[1])))


def _aspect(log_width, log_height):
    """Distance of a width over the height from the nearest usual aspect ratio; 0 where the height is unknown."""
    off = np.min([np.abs(log_width - log_height - math.log(a)) for a in ASPECTS], axis=0)
    return np.where(np.isnan(log_height), 0.0, off)


def _width_values(plain, dpi) -> dict:
    """Pixels that a number without a unit would be in each unit; null for printed units of unknown resolution."""
    return {"px": plain, "kpx": plain * 1000} | {u: plain / per * dpi for u, per in _INCH.items()}


def _focal_values(plain, px) -> dict:
    """Focal ratio that a number without a unit would be in each unit, the frame being ``px`` pixels wide."""
    return {"ratio": plain, "percent": plain / 100, "permille": plain / 1000, "px": plain / px, "eq_mm": plain / FRAME_MM, "eq_cm": plain * 10 / FRAME_MM, "eq_in": plain * 25.4 / FRAME_MM}


def lens_agreement(parsed: DataFrame) -> DataFrame:
    """make, model, height, seen: for each camera model the classes of focal ratios that its records state with a unit, and their neighbours.

    ``seen`` maps a word of 64 classes to their bits, so it stays below two kilobytes however many records a model has.
    """
    stated = parsed.where("f_ratio is not null and make is not null and model is not null and height > 0")
    stated = stated.where(F.col("f_ratio").between(*FOCAL_RANGE))
    near = F.array(*(F.round(F.log("f_ratio") / AGREE).cast("int") + i for i in (-1, 0, 1)))
    each = stated.select("make", "model", "height", F.explode(near).alias("c"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("c", F.lit(64)).cast("int"))
    words = each.groupBy("make", "model", "height", F.floor(F.col("c") / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("make", "model", "height").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("seen"))


def writer_units(parsed: DataFrame, notes: DataFrame) -> DataFrame:
    """writer, wu, fu: the units of numbers without one, with width_open, focal_open (how many units are left) and the residual.

    ``parsed``: as of :func:`parsed_values`, with dpi. For each writer and each combination of units the
    residuals of the identities are averaged over all records that can be tested (each cut at ``CAP``); the
    least sum wins. Units whose residual comes within ``MARGIN`` of the least can't be told apart: of these,
    the one that the writer's note names is taken, else the more usual one. Where the identities
    exclude no unit at all there is nothing to go by, and the unit stays null whatever the note says.
    """
    refs = lens_agreement(parsed)
    rows = parsed.where("w_plain is not null or f_plain is not null").join(broadcast_if_small(refs, refs.count(), 2048), ["make", "model", "height"], "left")
    wide = _width_values(F.col("w_plain"), F.col("dpi"))
    # a focal length in pixels goes with each unit that the width may have
    focal = {u: x for u, x in _focal_values(F.col("f_plain"), F.lit(1.0)).items() if u != "px"}
    focal |= {f"px_{u}": F.col("f_plain") / F.coalesce(F.col("w_px"), x) for u, x in wide.items()}
    each = F.array(*(F.struct(F.lit(f"{k}_{u}").alias("unit"), F.lit(k == "w").alias("wide"), x.alias("value")) for k, all_ in (("w", wide), ("f", focal)) for u, x in all_.items()))
    rows = rows.select("writer", F.when(F.col("height") > 0, F.col("height")).alias("height"), "seen", F.inline(each)).where("value is not null").withColumn("log", F.log("value"))
    log = F.col("log")
    low, high = (F.when(F.col("wide"), math.log(w)).otherwise(math.log(f)) for w, f in zip(WIDTH_RANGE, FOCAL_RANGE))
    outside = F.greatest(F.lit(0.0), low - log, log - high)
    aspect = F.coalesce(F.least(*(F.abs(log - F.log("height") - math.log(a)) for a in ASPECTS)), F.lit(0.0))
    c = F.round(log / AGREE).cast("int")
    word = F.coalesce(F.try_element_at("seen", F.floor(c / 64).cast("int")), F.lit(0).cast("long"))
    hit = F.call_function("shiftright", word, F.pmod(c, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    strange = F.when(F.col("seen").isNull() | hit, 0.0).otherwise(CAP)
    means = rows.groupBy("writer", "unit").agg(F.avg(F.least(F.lit(CAP), outside + F.when(F.col("wide"), aspect).otherwise(strange))).alias("mean"))
    means = means.groupBy("writer").agg(F.collect_list("unit").alias("units"), F.collect_list("mean").alias("means"))
    means = means.join(broadcast_if_small(notes, notes.count(), 512), means["writer"].eqNullSafe(notes["writer"]), "left").drop(notes["writer"])
    return means.mapInPandas(_decide, "writer string, wu string, fu string, width_open int, focal_open int, residual double")


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each writer the combination of units with the least sum of mean residuals."""
    for b in batches:
        out = []
        for r in b.to_dict("records"):
            mean = dict(zip(r["units"], r["means"]))
            wide = {u: mean[f"w_{u}"] for u in WIDTH_UNITS if f"w_{u}" in mean} or dict.fromkeys(WIDTH_UNITS, 0.0)  # an untested value says nothing
            name = lambda w, u: f"f_px_{w}" if u == "px" else f"f_{u}"
            focal = {(w, u): mean[name(w, u)] for w in WIDTH_UNITS for u in FOCAL_UNITS if name(w, u) in mean} or {(w, u): 0.0 for w in WIDTH_UNITS for u in FOCAL_UNITS}
            cost = {(w, u): wide[w] + v for (w, u), v in focal.items() if w in wide}
            least = min(cost.values())
            left = [k for k, c in cost.items() if c <= least + MARGIN]
            named = lambda k: (r["note_w"] is not None and k[0] != r["note_w"]) + (r["note_f"] is not None and k[1] != r["note_f"])
            wu, fu = min(left, key=lambda k: (named(k), WIDTH_UNITS.index(k[0]) + FOCAL_UNITS.index(k[1]), cost[k]))
            n = [len({k[i] for k in left}) for i in (0, 1)]
            every = [len({k[i] for k in cost}) for i in (0, 1)]
            out.append((r["writer"], wu if n[0] < every[0] else None, fu if n[1] < every[1] else None, *n, cost[wu, fu]))
        yield pd.DataFrame(out, columns=["writer", "wu", "fu", "width_open", "focal_open", "residual"])


def _chosen(values: dict, cost: dict, unit: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, value and number of open units of each record: its writer's unit, or its own best where that is unknown or makes it impossible."""
    names = list(values)
    value, off = np.stack([values[u] for u in names], 1), np.stack([cost[u] for u in names], 1)
    off = np.where(np.isnan(off), np.inf, off)
    at = np.array([names.index(u) if isinstance(u, str) else -1 for u in unit])
    row = np.arange(len(at))
    near = (np.isfinite(off) & (off <= off.min(1, keepdims=True) + MARGIN)).sum(1)
    doubted = (at < 0) | (np.isfinite(off[row, at]) & (off[row, at] > ALONE))
    alone = doubted & (near < np.isfinite(off).sum(1))
    at = np.where(alone, off.argmin(1), at)
    n = np.where(alone, near, left)
    known = (at >= 0) & ~np.isnan(value[row, at])
    return np.where(known, np.array([*names, None], dtype=object)[at], None), np.where(known, value[row, at], np.nan), np.where(np.isnan(value).all(1), 0, n)


def resolved_units(exif: DataFrame, writers: DataFrame) -> DataFrame:
    """shot_id, writer, the unit and value of focal and width, and ``ambiguous``.

    A unit in the value is taken as it is (``stated``). A number without one gets its writer's unit
    (:func:`writer_units`); if there is none, or it makes the record itself impossible by more than a factor of e,
    the record is judged alone by its ranges, as far as they exclude a unit. ``ambiguous`` marks records whose unit the identities did not
    tell from another by themselves. Values that can't be read, are not positive, or need a width that can't be read
    stay null, as do numbers in printed units of which no note tells the resolution. Records
    without a writer form one writer; without the columns make and model, or where they are null, no lenses are compared.
    """
    notes = writers.where("writer is not null").groupBy("writer").agg(F.max("note").alias("note"))
    far, wide = note_units(F.col("note"))
    notes = written(notes.select("writer", far.alias("note_f"), F.regexp_replace(wide, "@.*", "").alias("note_w"), F.regexp_extract(wide, "@([0-9]+)", 1).try_cast("double").alias("dpi")))
    camera = [F.col(c) if c in exif.columns else F.lit(None).cast("string").alias(c) for c in ("make", "model")]
    rows = exif.where("shot_id is not null").select("shot_id", "writer", *camera, "width", "height", "focal_ratio").distinct()
    parsed = written(parsed_values(rows).join(broadcast_if_small(notes.select("writer", "dpi"), notes.count(), 512), "writer", "left"))
    chosen = written(writer_units(parsed, notes.drop("dpi")).withColumnRenamed("writer", "_writer"))
    r = parsed.join(broadcast_if_small(chosen, chosen.count(), 512), F.col("writer").eqNullSafe(F.col("_writer")), "left")

    @F.pandas_udf("width_unit string, width_px double, focal_unit string, focal_over_width double, ambiguous boolean")
    def choose(height: pd.Series, dpi: pd.Series, w_px: pd.Series, w_alt: pd.Series, w_plain: pd.Series, f_ratio: pd.Series, f_px: pd.Series, f_plain: pd.Series,
               wu: pd.Series, fu: pd.Series, w_open: pd.Series, f_open: pd.Series) -> pd.DataFrame:
        array = lambda x: x.to_numpy(dtype=float, na_value=np.nan)
        tall, px, alt = array(height), array(w_px), array(w_alt)
        with np.errstate(invalid="ignore", divide="ignore"):
            lh = np.log(np.where(tall > 0, tall, np.nan))
            off = lambda v: _aspect(np.log(v), lh) + _outside(np.log(v), WIDTH_RANGE)
            px = np.where(np.isnan(px) | (off(alt) < off(px)), np.where(np.isnan(alt), px, alt), px)
            wide = _width_values(array(w_plain), array(dpi))
            # the writer's unit is doubted for impossible sizes only, an aspect ratio may be unusual
            unit, value, left_w = _chosen(wide, {u: _outside(np.log(v), WIDTH_RANGE) for u, v in wide.items()}, wu.to_numpy(), array(w_open))
            unit, value = np.where(np.isnan(px), unit, "stated"), np.where(np.isnan(px), value, px)
            focal = _focal_values(array(f_plain), value)
            funit, fvalue, left_f = _chosen(focal, {u: _outside(np.log(v), FOCAL_RANGE) for u, v in focal.items()}, fu.to_numpy(), array(f_open))
            given = array(f_ratio)
            given = np.where(np.isnan(given), array(f_px) / value, given)
            said = ~np.isnan(given)
            out = {"width_unit": unit, "width_px": value, "focal_unit": np.where(said, "stated", funit), "focal_over_width": np.where(said, given, fvalue)}
            return pd.DataFrame(out | {"ambiguous": (left_w > 1) | (left_f > 1)})

    r = r.withColumn("_c", choose("height", "dpi", "w_px", "w_alt", "w_plain", "f_ratio", "f_px", "f_plain", "wu", "fu", "width_open", "focal_open"))
    return r.select("shot_id", "writer", "_c.*", "residual")


def common_units(exif: DataFrame, writers: DataFrame) -> DataFrame:
    """shot_id, field_name, common_value: focal ratio in thousandths and width in pixels, rounded.

    One row for each readable, positive value, but for plain numbers of writers whose unit is the common
    one. Null shots are left out, repeated records come out once, an empty table gives no rows.
    """
    r = resolved_units(exif, writers)
    whole = lambda c: F.round(F.round(c, 6)).cast("long")
    each = F.array(
        F.struct(F.lit("focal_ratio").alias("field_name"), F.when(~F.coalesce(F.col("focal_unit") == "ratio", F.lit(False)), whole(F.col("focal_over_width") * 1000)).alias("common_value")),
        F.struct(F.lit("width").alias("field_name"), F.when(~F.coalesce(F.col("width_unit") == "px", F.lit(False)), whole(F.col("width_px"))).alias("common_value")),
    )
    return r.select("shot_id", F.inline(each)).where("common_value is not null").distinct()


def ambiguity_report(resolved: DataFrame) -> DataFrame:
    """Per writer: records, and those whose units no identity tells apart."""
    return resolved.groupBy("writer").agg(F.count(F.lit(1)).alias("n_records"), F.count(F.when(F.col("ambiguous"), 1)).alias("n_ambiguous"))
