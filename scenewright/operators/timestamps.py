"""Mixed timestamp texts to one UTC instant: all readings of a value, chosen by Viterbi over the order of record.

Reading a text is done in generated JVM code; only records with more than one reading, and their
neighbours, are decided in Python.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import group_codes, ordered_partitions

_DAY = 86_400_000_000
# Month names as texts carry them, and the years in which a bare number is taken for an instant.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
EPOCH_YEARS = (1990, 2100)

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r"\s*(Z|z|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|UTC|GMT|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)?"
_DASHED = r"^\s*(\d{4})[-:/.](\d{1,2})[-:/.](\d{1,2})[T ]+" + _TIME + _ZONE + r"\s*$"
_COMPACT = r"^\s*(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?" + _ZONE + r"\s*$"
_SLASHED = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})[ ,T]+" + _TIME + r"\s*([AaPp][Mm])?" + _ZONE + r"\s*$"
_NAMED = r"^\s*(\d{1,2})[ -]([A-Za-z]{3})[a-z]*[ -](\d{4})[ ,]+" + _TIME + _ZONE + r"\s*$"
_NUMBER = r"^\s*(\d+(?:\.\d*)?(?:[eE]\+?\d{1,2})?)\s*$"

#: Cost of a step back in time, of a date that the day-month order can't read, of a switch between the two
#: formats of slash dates, and for each unit of log(1 + minutes) of a step forward.
BACKWARD, UNREADABLE, SWITCH, FORWARD = 100.0, 1000.0, 1000.0, 0.1
#: Texts may drop digits, so a step back of up to this many microseconds is none.
TOLERANCE = 1_000_000


def _zone_offset(us: Column, zone: Column) -> Column:
    """Microseconds that clocks of ``zone`` are ahead at the UTC instant ``us``."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)) - us


def _instants(local: Column, zone: Column) -> Column:
    """All instants at which clocks of ``zone`` show ``local``: none when skipped, two when shown twice."""
    a = local - _zone_offset(local - F.lit(_DAY), zone)
    b = local - _zone_offset(local + F.lit(_DAY), zone)
    return F.array_sort(F.array_distinct(F.filter(F.array(a, b), lambda x: (x + _zone_offset(x, zone)) == local)))


def with_readings(df: DataFrame, text: str, zone: str) -> DataFrame:
    """Adds ``first`` and ``second``: arrays of the instants (microseconds) that the text may name.

    ``first`` reads slash dates day first, ``second`` month first; for other texts they are equal.
    ``first_date`` and ``second_date`` tell whether the order makes a date at all, so that a time skipped
    by a clock change differs from an unreadable date; ``slash`` marks slash dates. Unknown zones read as
    no zone at all and give no instant; a null zone of the source is UTC. Dates of year 0 or 1970 are
    placeholders and no dates.
    """
    spark = df.sparkSession
    zones = sorted(spark._jvm.java.lang.String.join(",", spark._jvm.java.time.ZoneId.getAvailableZoneIds()).split(","))
    t = F.col(text)

    fields = ["y", "mo", "d", "h", "mi", "s", "fr", "z", "half", "num"]

    def shaped(pattern: str, names: list[str], kind: str) -> Column:
        """The text with its fields in a fixed order, each after a mark: one run of the pattern finds all of them."""
        groups = {n: f"${i + 1}" for i, n in enumerate(names)}
        return F.regexp_replace(t, pattern, "\u0001".join([f"\u0001{kind}", *(groups.get(n, "") for n in fields)]))

    shapes = [
        shaped(_DASHED, ["y", "mo", "d", "h", "mi", "s", "fr", "z"], "date"),
        shaped(_COMPACT, ["y", "mo", "d", "h", "mi", "s", "fr", "z"], "date"),
        shaped(_SLASHED, ["d", "mo", "y", "h", "mi", "s", "fr", "half", "z"], "slash"),
        shaped(_NAMED, ["d", "mo", "y", "h", "mi", "s", "fr", "z"], "named"),
        shaped(_NUMBER, ["num"], "number"),
    ]
    # a pattern is tried on what the ones before it left as it was
    for shape in shapes:
        df = df.withColumn("_m", F.when(F.col("_m").startswith("\u0001"), F.col("_m")).otherwise(shape) if "_m" in df.columns else shape)
    parts = F.split("_m", "\u0001")
    df = df.withColumn("_p", F.when(F.col("_m").startswith("\u0001"), F.struct(*(parts[i + 1].alias(n) for i, n in enumerate(["kind", *fields])))))
    p = lambda n: F.col(f"_p.{n}")
    hour, minute, second = (F.coalesce(p(n).try_cast("int"), F.lit(0)) for n in ("h", "mi", "s"))
    half = F.lower(p("half"))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0)).otherwise(99)
    fits = (hour24 <= 23) & (minute <= 59) & (second <= 59)
    micros = F.rpad(F.substring(p("fr"), 1, 6), 6, "0").cast("long")
    time = F.when(fits, (hour24 * 3600 + minute * 60 + second).cast("long") * 1_000_000 + micros)
    month = F.when(p("kind") == "named", F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(p("mo"))).cast("string")).otherwise(p("mo"))
    date = lambda m, d: F.unix_date(F.when(~p("y").isin("0000", "1970"), F.concat_ws("-", p("y"), m, d)).try_cast("date")).cast("long") * F.lit(_DAY) + F.col("_time")
    dated = p("kind") != "number"
    number = p("num").try_cast("decimal(38,9)")
    low, high = (int(pd.Timestamp(year=y, month=1, day=1).timestamp()) for y in EPOCH_YEARS)
    scale = lambda k: F.when((number >= low * k) & (number < high * k), F.floor(number * F.lit(1_000_000) / F.lit(k)).cast("long"))
    digits = F.regexp_replace(p("z"), r"[^0-9]", "")
    minutes = F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")
    named_zone = p("z").contains("/")
    fixed = F.when(p("z").rlike("^(?i)(z|utc|gmt)$"), F.lit(0)).when(p("z").rlike(r"[+-]\d"), minutes * F.when(p("z").contains("-"), -1).otherwise(1))
    zone_name = F.when(p("z") == "", F.coalesce(F.col(zone), F.lit("UTC"))).when(named_zone, p("z"))
    df = df.withColumns(
        {
            "_time": F.when(dated, time),
            "_fixed": F.when(dated & ~named_zone, fixed.cast("long") * 60_000_000),
            "_zone": F.when(dated & zone_name.isin(zones), zone_name),
            "_epoch": F.when(~dated, F.coalesce(scale(1), scale(1000), scale(1_000_000), scale(1_000_000_000))),
        }
    )
    df = df.withColumns({"_l1": F.when(dated, date(month, p("d"))), "_l2": F.when(p("kind") == "slash", date(p("d"), p("mo"))).when(dated, date(month, p("d")))})
    none = F.array().cast("array<bigint>")

    def readings(local: Column) -> Column:
        zoned = F.when(F.col("_zone").isNotNull(), _instants(local, F.coalesce(F.col("_zone"), F.lit("UTC"))))
        return F.when(F.col("_epoch").isNotNull(), F.array("_epoch")).when(local.isNull(), none).when(F.col("_fixed").isNotNull(), F.array(local - F.col("_fixed"))).otherwise(F.coalesce(zoned, none))

    df = df.withColumns({"first": readings(F.col("_l1")), "second": readings(F.col("_l2"))})
    df = df.withColumns({"first_date": F.col("_l1").isNotNull(), "second_date": F.col("_l2").isNotNull(), "slash": F.coalesce(p("kind") == "slash", F.lit(False))})
    return df.drop("_m", "_p", "_time", "_fixed", "_zone", "_epoch", "_l1", "_l2")


def _step(a: float, b: float) -> float:
    gap = b - a
    if gap < -TOLERANCE:
        return BACKWARD
    return FORWARD * math.log1p(gap / 60e6) if gap > 0 else 0.0  # not a number before the first reading


def _visited(rows: dict[str, np.ndarray], i: int, j: int) -> list[int]:
    """Rows of [i, j) that a choice has to look at: those with more than one reading, the certain ones next to them, and the outermost.

    The steps between the other rows are the same whatever is chosen.
    """
    values = rows["values"][i:j]
    read = ~np.isnan(values)
    at = np.flatnonzero(read.any(1))
    if not len(at):
        return []
    certain = read[at, 0] & read[at, 2] & ~read[at, 1] & ~read[at, 3] & (values[at, 0] == values[at, 2])
    seen = ~certain
    seen[1:] |= ~certain[:-1]
    seen[:-1] |= ~certain[1:]
    seen[[0, -1]] = True
    return (at[seen] + i).tolist()


def _viterbi(rows: dict[str, np.ndarray], at: list[int], first: int | None = None) -> tuple[list[float], list[float], list[list[int]]]:
    """Cheapest paths over the rows ``at`` to each state of the last one: their costs, last instants, and links back.

    A state is a day-month order and one of at most two readings under it: 0 and 1 are readings day first, 2 and 3
    month first. A row that an order can't read keeps the order's states. ``first`` fixes the state at the first row.
    """
    inf, nan = math.inf, math.nan
    values, missed = rows["values"], rows["missed"]
    cost, last, links = [], [], []
    for t, r in enumerate(at):
        v = values[r].tolist()
        new, now, link = [inf] * 4, [nan] * 4, [-1] * 4
        for o in (0, 2):
            if v[o] == v[o]:
                for s in (o, o + 1):
                    x = v[s]
                    if x != x:
                        continue
                    if not t:
                        new[s], now[s] = 0.0, x
                        continue
                    best, via = inf, -1
                    for q in range(4):
                        c = cost[q]
                        if c < inf:
                            c += _step(last[q], x) + (SWITCH if (q < 2) != (o < 2) else 0.0)
                            if c < best:
                                best, via = c, q
                    new[s], now[s], link[s] = best, x, via
            else:
                miss = missed[r, o // 2]
                for s in (o, o + 1):
                    new[s], now[s], link[s] = (cost[s] + miss, last[s], s) if t else (miss if s == o else inf, nan, -1)
        if not t and first is not None:
            new = [c if s == first else inf for s, c in enumerate(new)]
        cost, last = new, now
        links.append(link)
    return cost, last, links


def _picked(links: list[list[int]], end: int) -> list[int]:
    picks = [end]
    for link in reversed(links[1:]):
        picks.append(link[picks[-1]])
    return picks[::-1]


def _columns(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """values: the readings by state; missed: the cost of a slash date that an order can't read and the other can."""
    # instants of this era stay exact in a double up to 2^53 microseconds
    values = pdf[["a0", "a1", "b0", "b1"]].to_numpy(dtype=float)
    slash, ok0, ok1 = (pdf[c].to_numpy(dtype=bool) for c in ("slash", "first_date", "second_date"))
    missed = np.stack([slash & ~ok0 & ok1, slash & ~ok1 & ok0], axis=1) * UNREADABLE
    return {"values": values, "missed": missed}


def utc_instants(records: DataFrame, zones: DataFrame, key: str, source: str, text: str, zone: str, order: list[str] | None = None) -> DataFrame:
    """``key``, ``utc_ms``: one row for each record of ``records`` whose ``text`` names an instant.

    Records of one ``source`` follow each other by ``order`` (``key`` if not given); ``zones`` gives the
    time zone of a source (null, or no row: UTC; given twice: the smallest). Choices are the cheapest by
    Viterbi over that order, whose states are the readings under either day-month order: switches between
    the two formats, dates that the format can't read and steps back in time cost most, long steps forward a little.
    Numbers outside the years of ``EPOCH_YEARS`` name no instant. Repeated keys count once, with their smallest text; null keys
    are left out, records of a null source form one source. Empty tables give no rows.

    A source of any size spreads over many partitions. For each piece of a source that crosses a cut, the
    cheapest costs between its first and last readings are found where it lies; the driver joins those few
    matrices, at most two a partition, and the pieces are then decided with their ends fixed.
    """
    order = order or [key]
    rows = records.where(F.col(key).isNotNull()).groupBy(source, key, *[o for o in order if o != key]).agg(F.min(text).alias("_text"))
    tz = zones.where(F.col(source).isNotNull()).groupBy(source).agg(F.min(zone).alias("_tz"))
    rows = rows.join(tz, source, "left")
    pick = lambda c, i: F.get(F.col(c), F.lit(i)).cast("double")

    def read(ranged: DataFrame) -> DataFrame:
        return with_readings(ranged, "_text", "_tz").select(
            source, *order, *([key] if key not in order else []),
            pick("first", 0).alias("a0"), pick("first", 1).alias("a1"), pick("second", 0).alias("b0"), pick("second", 1).alias("b1"),
            "slash", "first_date", "second_date",
        )

    parts = ordered_partitions(rows, [source], order, halo=1, then=read)
    fixed = _join_pieces(parts, source) if parts.spanning else {}
    sent = parts.df.sparkSession.sparkContext.broadcast(fixed)

    def decide(pdf: pd.DataFrame, pid: int) -> pd.DataFrame:
        pdf = pdf[pdf["_core"]].reset_index(drop=True)
        rows = _columns(pdf)
        starts, _ = group_codes(pdf, [source])
        ends = np.append(starts[1:], len(pdf))
        values = rows["values"]
        out = values[:, 0].copy()
        several = ~np.isnan(values[:, 1]) | pdf["slash"].to_numpy(dtype=bool) | ~np.isnan(values[:, 3])
        for i, j in zip(starts.tolist(), ends.tolist()):
            name = pdf[source].iat[i]
            first, last = sent.value.get((pid, None if pd.isna(name) else name), (None, None))
            if not several[i:j].any():
                continue
            at = _visited(rows, i, j)
            if not at:
                continue
            cost, _, links = _viterbi(rows, at, first)
            picks = _picked(links, min(range(4), key=cost.__getitem__) if last is None else last)
            # a state kept over a row that its order can't read is no reading of that row
            out[at] = [values[r, p] if values[r, p - p % 2] == values[r, p - p % 2] else math.nan for r, p in zip(at, picks)]
        named = ~np.isnan(out)
        return pd.DataFrame({key: pdf[key][named], "utc_ms": np.floor_divide(out[named].astype(np.int64), 1000)})

    return parts.map(decide, f"`{key}` {records.schema[key].dataType.simpleString()}, utc_ms bigint")


def _join_pieces(parts, source: str) -> dict:
    """(partition, source) -> (state at the first row, at the last) for sources that cross a cut."""
    spanning = parts.df.sparkSession.sparkContext.broadcast({k[0] for k in parts.spanning})

    def costs(pdf: pd.DataFrame, pid: int) -> pd.DataFrame:
        pdf = pdf[pdf["_core"]].reset_index(drop=True)
        rows = _columns(pdf)
        starts, _ = group_codes(pdf, [source])
        ends = np.append(starts[1:], len(pdf))
        found = []
        for i, j in {(int(starts[0]), int(ends[0])), (int(starts[-1]), int(ends[-1]))}:
            name = pdf[source].iat[i]
            name = "\0null" if pd.isna(name) else name
            if name not in spanning.value:
                continue
            at = _visited(rows, i, j)
            runs = [_viterbi(rows, at, f)[:2] for f in range(4)] if at else []
            heads = rows["values"][at[0]].tolist() if at else []
            found.append((pid, name, heads, [c for r in runs for c in r[0]], [v for r in runs for v in r[1]]))
        return pd.DataFrame(found, columns=["pid", "name", "heads", "matrix", "tails"])

    table = parts.map(costs, "pid int, name string, heads array<double>, matrix array<double>, tails array<double>").toPandas()
    fixed: dict = {}
    for name, pieces in table.groupby("name"):
        label = None if name == "\0null" else name
        reach, trail = None, []  # cheapest cost and last instant by state
        for _, p in pieces.sort_values("pid").iterrows():
            if not len(p["heads"]):
                trail.append((int(p["pid"]), None, None))
                continue
            heads, m, tails = (np.asarray(p[c], dtype=float) for c in ("heads", "matrix", "tails"))
            m, tails = m.reshape(4, 4), tails.reshape(4, 4)
            enter, via = np.zeros(4), [0] * 4
            if reach is not None:
                steps = np.array([[c + _step(v, heads[f]) + (SWITCH if (q < 2) != (f < 2) else 0.0) for q, (c, v) in enumerate(zip(*reach))] for f in range(4)])
                enter, via = steps.min(1), steps.argmin(1).tolist()
            full = enter[:, None] + m
            came = full.argmin(0)
            trail.append((int(p["pid"]), came.tolist(), via))
            reach = (full.min(0).tolist(), tails[came, np.arange(4)].tolist())
        last = int(np.argmin(reach[0])) if reach is not None else None
        for pid, came, via in reversed(trail):
            if came is None:
                fixed[pid, label] = (None, None)
                continue
            fixed[pid, label] = (came[last], last)
            last = via[came[last]]
    return fixed


def capture_instants(measurements: DataFrame, groups: DataFrame) -> DataFrame:
    """shot_id, utc_ms for every shot whose ``capture_time`` names an instant."""
    return utc_instants(measurements, groups, "shot_id", "sequence_key", "capture_time", "time_zone")
