"""Sessions: dated opening hours, positions and short days, the day's shape of volatility, and pooled forecasts from running moments."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import true
from quillon.functions.windows import Bars

DAY = 24 * 60
HAR = ("log_c", "log_c_w", "log_c_m", "log1p_j", "r_neg")
#: Signs of HAR's weights: 1 not negative, -1 not positive.
SIGNS = (1, 1, 1, 1, -1)


def session_edges(df: DataFrame, anchor: Column, minute: str = "local_minute") -> DataFrame:
    """root, session_id, start_elapsed, end_elapsed, bars: first and last minute of each session, counted from the instrument's anchor."""
    elapsed = F.pmod(F.col(minute) - anchor, F.lit(DAY)).cast("int")
    return df.withColumn("q_e", elapsed).groupBy("root", "session_id").agg(F.min("q_e").alias("start_elapsed"), F.max("q_e").alias("end_elapsed"), F.count("*").alias("bars"), F.first(anchor).cast("int").alias("anchor"))


def session_specs(daily: DataFrame, step: int = 15, latest: int = 30, recent: int = 10, least: int = 5, share: float = 0.9) -> DataFrame:
    """root, segment, valid_from, valid_to, sessions, start_minute, end_minute: opening hours, with one change of the opening time at most. daily: ``session_edges``.

    Openings within ``latest`` minutes of the anchor count, rounded to ``step`` minutes. The last regime is the most frequent opening of the ``recent`` last (the smallest on a tie). It starts at the first session with
    this opening from which on at least ``least`` openings follow, ``share`` of them the same. Within a segment the start is the median of the counted openings and the end the last minutes' 95th percentile (the nearest
    value).
    """
    q = (F.rint(F.col("start_elapsed") / step) * step).cast("int")
    x = daily.withColumns({"q_ok": F.col("start_elapsed") <= latest, "q_o": q})
    down = W.partitionBy("root").orderBy(F.desc("session_id"))
    tail = F.sum(F.col("q_ok").cast("int")).over(down)
    x = x.withColumn("q_tail", tail)
    last = x.where(F.col("q_ok") & (F.col("q_tail") <= recent)).groupBy("root", "q_o").agg(F.count("*").alias("n"))
    last = last.groupBy("root").agg(F.max_by("q_o", F.struct("n", -F.col("q_o"))).alias("q_last"))
    several = x.where("q_ok").groupBy("root").agg((F.count_distinct("q_o") > 1).alias("q_several"))
    x = x.join(last, "root", "left").join(several, "root", "left").withColumn("q_same", F.sum((F.col("q_ok") & (F.col("q_o") == F.col("q_last"))).cast("int")).over(down))
    opens = true(F.col("q_several") & F.col("q_ok") & (F.col("q_o") == F.col("q_last")) & (F.col("q_tail") >= least) & (F.col("q_same") >= share * F.col("q_tail")))
    w = W.partitionBy("root")
    x = x.withColumn("q_from", F.min(F.when(opens, F.col("session_id"))).over(w)).withColumn("q_first", F.min("session_id").over(w))
    x = x.withColumn("segment", F.when(true((F.col("session_id") >= F.col("q_from")) & (F.col("q_from") > F.col("q_first"))), 1).otherwise(0))
    s = W.partitionBy("root", "segment")
    place = F.row_number().over(s.orderBy("end_elapsed", "session_id"))
    nearest = F.rint((F.count("*").over(s) - 1) * 0.95) + 1
    x = x.withColumn("q_end", F.when(place == nearest, F.col("end_elapsed")))
    out = x.groupBy("root", "segment").agg(
        F.min("session_id").alias("valid_from"), F.max("session_id").alias("valid_to"), F.count("*").alias("sessions"), F.floor(F.percentile(F.when(F.col("q_ok"), F.col("start_elapsed")), 0.5)).alias("a"), F.max("q_end").alias("b"), F.first("anchor").alias("anchor"),
    )
    at = lambda c: F.pmod(F.col("anchor") + F.col(c), F.lit(DAY)).cast("int")
    return out.select("root", "segment", "valid_from", "valid_to", "sessions", at("a").alias("start_minute"), F.pmod(at("b") + 1, F.lit(DAY)).cast("int").alias("end_minute"))


def dated_positions(df: DataFrame, specs: DataFrame, special: DataFrame, bar_minutes: int, anchor: Column, slack: int = 5) -> DataFrame:
    """df with bar_in_session, phi (share of the expected session that has passed, one at most), is_half_day and is_truncated.

    df: root, timestamp, session_id, local_minute, local_symbol. specs: ``session_specs``; special: root, session_id, expected (bars, or null), half (true for a short day). A session is truncated if it isn't the
    instrument's last, no short day, not the last of an expiring symbol, and ends over ``slack`` minutes before the end that its specs give.
    """
    s, r = W.partitionBy("root", "session_id"), W.partitionBy("root")
    length = F.pmod(F.col("end_minute") - F.col("start_minute"), F.lit(DAY))
    dated = specs.select("root", "valid_from", "valid_to", "end_minute", F.floor(length / bar_minutes).alias("q_bars"))
    days = df.select("root", "session_id").distinct()
    days = days.join(dated, (days["root"] == dated["root"]) & days["session_id"].between(dated["valid_from"], dated["valid_to"]), "left").drop(dated["root"])  # a few segments an instrument
    days = days.join(special, ["root", "session_id"], "left").select("root", "session_id", F.coalesce("expected", "q_bars").alias("q_bars"), "end_minute", true(F.col("half")).alias("is_half_day"))
    x = df.join(days, ["root", "session_id"]).withColumn("q_e", F.pmod(F.col("local_minute") - anchor, F.lit(DAY)))
    number = F.row_number().over(s.orderBy("timestamp")) - 1
    x = x.withColumns({"bar_in_session": number.cast("int"), "q_last": F.max("session_id").over(r), "q_close": F.max("q_e").over(s), "q_until": F.max("session_id").over(W.partitionBy("root", "local_symbol")), "q_now": F.max_by("local_symbol", "timestamp").over(r)})
    expires = (F.col("session_id") == F.col("q_until")) & (F.col("local_symbol") != F.col("q_now"))
    short = F.col("q_close") < F.pmod(F.col("end_minute") - 1 - anchor, F.lit(DAY)) - slack
    return x.withColumns({
        "phi": F.least(F.col("bar_in_session") / F.nullif(F.col("q_bars") - 1, F.lit(0)), F.lit(1.0)), "is_truncated": true((F.col("session_id") < F.col("q_last")) & ~F.col("is_half_day") & ~expires & short),
    }).drop("q_bars", "end_minute", "q_e", "q_last", "q_close", "q_until", "q_now")


def seasonal_curves(df: DataFrame, every: int = 5, first: int = 20) -> DataFrame:
    """root, refit, slot, median, mean of |z| by the slots of the day, from all sessions before each refit. df: root, session_no (from 0), slot, abs_z.

    An expanding window by slot gives the values after each session; the last before a refit is what it sees. No row is copied to the refits it serves.
    """
    last = df.agg(F.max("session_no")).first()[0]
    if last is None or last + 1 < first:
        last = first - 2
    x = df.where("abs_z IS NOT NULL")
    w = W.partitionBy("root", "slot").orderBy("session_no").rangeBetween(W.unboundedPreceding, 0)
    x = x.select("root", "slot", "session_no", F.percentile("abs_z", 0.5).over(w).alias("m"), F.avg("abs_z").over(w).alias("a"))
    refit = F.when(F.col("session_no") < first, first).otherwise(first + F.expr(f"(session_no - {first}) div {every} + 1") * every).cast("int")
    known = x.groupBy("root", "slot", refit.alias("refit")).agg(F.max_by(F.struct("m", "a"), "session_no").alias("v")).where(F.col("refit") <= last + 1)
    grid = known.groupBy("root", "slot").agg(F.min("refit").alias("q_from")).select("root", "slot", F.explode(F.sequence("q_from", F.lit(first + (last + 1 - first) // every * every), F.lit(every))).alias("refit"))
    held = Bars(["root", "slot"], "refit").ffill(F.col("v"))
    return grid.join(known, ["root", "slot", "refit"], "left").withColumn("v", held).select("root", "refit", "slot", F.col("v.m").alias("median"), F.col("v.a").alias("mean"))


def lowess(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 3) -> np.ndarray:
    """Local linear fits with tricube weights over the nearest share of points, refitted with bisquare weights of the residuals."""
    n = len(x)
    k = min(max(int(share * n + 1e-10), 2), n)
    robust, out = np.ones(n), np.empty(n)
    for _ in range(rounds + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.partition(d, k - 1)[k - 1]
            w = np.where(d < 0.999 * h, (1 - np.clip(d / max(h, 1e-12), 0, 1) ** 3) ** 3, 0.0)
            w[d <= 0.001 * h] = 1.0
            w = w * robust
            if w.sum() <= 0:
                out[i] = y[i]
                continue
            m = w @ x / w.sum()
            v = w @ (x - m) ** 2
            slope = (w @ ((x - m) * y)) / v if v > 1e-12 else 0.0
            out[i] = w @ y / w.sum() + slope * (x[i] - m)
        r = np.abs(y - out)
        scale = 6 * np.median(r)
        if scale < 1e-12:
            break
        u = r / scale
        robust = np.where(u < 0.999, (1 - np.clip(u, 0, 1) ** 2) ** 2, 0.0)
        robust[u <= 0.001] = 1.0
    return out


def seasonality(curves: DataFrame, share: float = 0.1, width: int = 5, low: float = 0.4, high: float = 2.5, events: tuple[int, ...] = (), event_roots: tuple[str, ...] = ()) -> DataFrame:
    """root, refit, slot, seas: medians through a median filter and local fits, scaled to the mean within bounds (the slots in ``events`` of ``event_roots`` keep their mean), with a root mean square of one.
    A group is one curve, at most the slots of a day."""

    def smooth(pdf):
        pdf = pdf.sort_values("slot")
        y, mean, half = pdf["median"].to_numpy(float), pdf["mean"].to_numpy(float), width // 2
        if len(y) < 3:
            return pdf[["root", "refit", "slot"]].assign(seas=1.0)
        padded = np.concatenate((np.full(half, y[0]), y, np.full(half, y[-1])))
        curve = lowess(pdf["slot"].to_numpy(float), np.median(np.lib.stride_tricks.sliding_window_view(padded, width), axis=1), share)
        curve = curve * np.clip(mean / np.where(curve == 0, 1e-12, curve), low, high)
        if pdf["root"].iloc[0] in event_roots:
            curve = np.where(np.isin(pdf["slot"].to_numpy(), events), mean, curve)
        return pdf[["root", "refit", "slot"]].assign(seas=curve / np.sqrt((curve**2).mean()))

    return curves.groupBy("root", "refit").applyInPandas(smooth, "root string, refit int, slot int, seas double")


def bounded_fit(a: np.ndarray, b: np.ndarray, signs: dict[int, int]) -> np.ndarray:
    """The minimum of x'ax - 2b'x with signs of some coordinates given: of all ways to hold some of these at zero the best that keeps the signs."""
    best, value = np.zeros(len(b)), np.inf
    for k in range(len(signs) + 1):
        for off in combinations(signs, k):
            on = [i for i in range(len(b)) if i not in off]
            x = np.zeros(len(b))
            x[on] = np.linalg.lstsq(a[np.ix_(on, on)], b[on], rcond=1e-10)[0]
            if all(s * x[i] >= -1e-12 for i, s in signs.items()) and (v := x @ a @ x - 2 * b @ x) < value - 1e-12:
                best, value = x, v
    return best


def pooled_har(records: DataFrame, pools: dict[str, list[str]], least: int = 40) -> DataFrame:
    """root, session_id, har_log_var: forecasts of each session from all sessions before it of the instrument's pool, with a level for each instrument and signs of the weights.

    records: ``har_records``. Every session adds its sums of products, a row a session; running sums over these rows give the moments that any day's fit needs, so a day costs the same however long the past
    is, and days are fitted in parallel. Features are standardised by the moments of the past.
    """
    size = max(map(len, pools.values()))
    of = {r: (p, i) for p, names in pools.items() for i, r in enumerate(sorted(names))}
    pick = lambda k: F.element_at(F.create_map(*[F.lit(x) for r, v in of.items() for x in (r, v[k])]), F.col("root"))
    known = reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(c) for c in HAR])
    rows = records.where(known & F.col("target_session").isNotNull() & F.col("root").isin(*of)).withColumns({"pool": pick(0), "level": pick(1)})
    names = ["q_1", *HAR, *[f"q_d{i}" for i in range(1, size)], "target_log_c"]
    rows = rows.withColumns({"q_1": F.lit(1.0)} | {f"q_d{i}": (F.col("level") == i).cast("double") for i in range(1, size)})
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    usable = F.col("target_log_c").isNotNull()
    sums = [F.coalesce(F.sum(F.when(usable, F.col(names[i]) * F.col(names[j]))), F.lit(0.0)).alias(f"m{i}_{j}") for i, j in cells]
    daily = rows.groupBy("pool", "target_session").agg(*sums, F.max(usable.cast("int")).alias("days"))
    before = W.partitionBy("pool").orderBy("target_session").rowsBetween(W.unboundedPreceding, -1)  # a row a session
    daily = daily.select("pool", "target_session", *[F.sum(f"m{i}_{j}").over(before).alias(f"m{i}_{j}") for i, j in cells], F.sum("days").over(before).alias("days")).where(F.col("days") >= least)
    p = len(names) - 1

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                m = np.zeros((p + 1, p + 1))
                for i, j in cells:
                    m[i, j] = m[j, i] = row[f"m{i}_{j}"]
                n = m[0, 0]
                t = np.eye(p)
                for k in range(1, 6):
                    mean = m[0, k] / n
                    sd = np.sqrt(max(m[k, k] - n * mean * mean, 0.0) / (n - 1)) if n > 1 else 0.0
                    sd = sd if sd > 1e-12 else 1.0
                    t[0, k], t[k, k] = -mean / sd, 1 / sd
                a, c = t.T @ m[:p, :p] @ t, t.T @ m[:p, p]
                used = [k for k in range(p) if k < 6 or m[k, k] > 0]
                x = np.zeros(p)
                x[used] = bounded_fit(a[np.ix_(used, used)], c[used], {used.index(k + 1): s for k, s in enumerate(SIGNS)})
                out.append((t @ x).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], names=["pool", "target_session", "beta"])

    kind = records.schema["target_session"].dataType.simpleString()
    fitted = daily.mapInArrow(fit, f"pool string, target_session {kind}, beta array<double>")
    value = reduce(Column.__add__, [F.col(c) * F.element_at("beta", i + 1) for i, c in enumerate(names[:-1])])
    return rows.join(fitted, ["pool", "target_session"]).select("root", F.col("target_session").alias("session_id"), value.alias("har_log_var"))
