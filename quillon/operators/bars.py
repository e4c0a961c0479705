"""From ticks and minutes to validated bars, returns and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalars import log, safe_div, true
from quillon.functions.windows import Bars


class DataContractError(ValueError):
    """A table breaks its contract."""


def ticks(events: DataFrame) -> DataFrame:
    """The events table as trades of five instruments."""
    size = (1 + F.col("user_id") % 5).cast("double")
    return events.select(
        F.col("event_type").alias("root"), "ts", "event_id", (F.lit(100.0) + F.col("value")).alias("price"), size.alias("volume"),
        F.when(F.col("event_id") % 2 == 0, size).otherwise(0.0).alias("taker"),
    )


def resample(trades: DataFrame, every: str = "1 hour") -> DataFrame:
    """OHLCV bars by UTC bucket; map-side combined, so a hot instrument is no hot task."""
    at = F.struct("ts", "event_id")
    bars = trades.groupBy("root", F.window("ts", every).start.alias("timestamp")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("quote"), F.sum(F.when(F.col("taker") > 0, F.col("price") * F.col("taker")).otherwise(0.0)).alias("taker_quote"), F.count("*").alias("bar_count"),
    )
    return bars.withColumn("wap", safe_div(F.col("quote"), F.col("volume"))).withColumn("is_valid", F.col("bar_count") >= 2)


def bars_of(spark: SparkSession, sf_dir: str, every: str = "1 hour") -> DataFrame:
    """Bars of the events table with session and contract."""
    found = resample(ticks(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")), every)
    decade = F.floor((F.dayofmonth("timestamp") - 1) / 10.0).cast("int").cast("string")
    return found.withColumn("session_id", F.to_date("timestamp")).withColumn("local_symbol", F.concat("root", F.lit("-"), decade))


def valid_mask(df: DataFrame) -> DataFrame:
    """Adds is_real, is_flat and is_filled: no trades, or a flat bar without volume."""
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    real = (F.col("bar_count") > 0) & (F.col("volume") > 0)
    return df.withColumns({"is_real": real, "is_flat": flat, "is_filled": ~real | (flat & (F.col("volume") == 0))})


def on_grid(bars: DataFrame, every: str = "1 hour") -> DataFrame:
    """Every bucket between an instrument's first and last bar; empty ones are filled bars that carry prices forward."""
    span = bars.groupBy("root").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    grid = span.select("root", F.explode(F.sequence("a", "b", F.expr(f"interval {every}"))).alias("timestamp"))
    prices = ["open", "high", "low", "close", "wap"]
    joined = grid.join(bars.select("root", "timestamp", *prices, "volume", "bar_count", "is_valid"), ["root", "timestamp"], "left")
    w = Bars("root", "timestamp")
    return joined.select("root", "timestamp", *[w.ffill(F.col(p)).alias(p) for p in prices], F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("bar_count", F.lit(0).cast("long")).alias("bar_count"), true(F.col("is_valid")).alias("is_valid"))


def resample_minutes(minutes: DataFrame, every: str = "5 minutes") -> DataFrame:
    """Minute bars to longer ones: prices from valid minutes only; a bucket without any carries the last prices forward, or its own last close."""
    m = valid_mask(minutes).withColumn("q_bucket", F.window("timestamp", every).start)
    valid = lambda c: F.when(~F.col("is_filled"), F.col(c))
    first = lambda c: F.min_by(valid(c), F.when(~F.col("is_filled"), F.col("timestamp")))
    last = lambda c: F.max_by(valid(c), F.when(~F.col("is_filled"), F.col("timestamp")))
    found = m.groupBy("root", F.col("q_bucket").alias("timestamp")).agg(
        F.max_by("local_symbol", m["timestamp"]).alias("local_symbol"), first("open").alias("open"), F.max(valid("high")).alias("high"), F.min(valid("low")).alias("low"), last("close").alias("close"),
        F.coalesce(F.sum(valid("volume")), F.lit(0.0)).alias("volume"), F.coalesce(F.sum(valid("bar_count")), F.lit(0)).cast("long").alias("bar_count"),
        F.sum(F.when(~F.col("is_filled"), F.col("wap") * F.col("volume"))).alias("q_wap"), F.count_if(~F.col("is_filled")).alias("n_valid"), F.max_by("close", m["timestamp"]).alias("q_close"),
    )
    found = found.withColumn("wap", safe_div(F.col("q_wap"), F.col("volume"))).withColumn("is_valid", F.col("n_valid") >= 2)
    w = Bars("root", "timestamp")
    return found.withColumns({c: F.coalesce(w.ffill(F.col(c)), F.col("q_close")) for c in ("open", "high", "low", "close", "wap")}).drop("q_wap", "q_close")


def add_returns(bars: DataFrame) -> DataFrame:
    """is_roll_boundary, ret (valid pair, one contract, one session) and overnight_ret (valid pair, one contract, two sessions)."""
    w = Bars("root", "timestamp")
    symbol = w.lag(F.col("local_symbol"))
    raw = log(F.col("close") / F.nullif(w.lag(F.col("close")), F.lit(0.0)))
    pair = true(F.col("is_valid") & w.lag(F.col("is_valid")) & (F.col("local_symbol") == symbol))
    same = true(F.col("session_id") == w.lag(F.col("session_id")))
    return bars.withColumns({"is_roll_boundary": symbol.isNotNull() & ~true(F.col("local_symbol") == symbol), "ret": F.when(pair & same, raw), "overnight_ret": F.when(pair & ~same, raw)})


def add_labels(bars: DataFrame, horizons: tuple[int, ...] = (6, 12, 24), sigma: str = "sigma_hat") -> DataFrame:
    """fwd_ret_h, fwd_ret_z_h, label_valid_h: enough valid bars ahead, no roll and at most one change of session."""
    w = Bars("root", "timestamp")
    before = w.lag(F.col("session_id"))
    work = bars.withColumn("q_change", F.when(true(F.col("session_id") == before), 0).otherwise(1))
    out = {}
    for h in horizons:
        later = w.lag(F.col("close"), -h)
        n_valid = w.ahead(F.sum, F.when(F.col("is_valid"), 1).otherwise(0), 0, h)
        rolls = F.sum(F.when(F.col("is_roll_boundary"), 1).otherwise(0)).over(w.frame(1, h))
        changes = F.sum("q_change").over(w.frame(1, h))
        ok = true(later.isNotNull() & (n_valid >= 0.6 * (h + 1)) & (F.coalesce(rolls, F.lit(0)) == 0) & (F.coalesce(changes, F.lit(0)) <= 1))
        ret = F.when(ok, log(later / F.nullif(F.col("close"), F.lit(0.0))))
        out |= {f"fwd_ret_{h}": ret, f"fwd_ret_z_{h}": safe_div(ret, F.col(sigma) * F.sqrt(F.lit(float(h)))), f"label_valid_{h}": ok}
    return work.withColumns(out).drop("q_change")


def validate(df: DataFrame, schema, key: list[str], roots: list[str] | None = None) -> None:
    """Columns and types in order, no nulls, unique keys, expected roots: one aggregate job and one grouping by key."""
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise DataContractError(f"schema {df.schema.simpleString()} is not {schema.simpleString()}")
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    if any(nulls.values()):
        raise DataContractError(f"nulls: {nulls}")
    if df.groupBy(*key).count().where("count > 1").limit(1).count():
        raise DataContractError(f"{key} is not unique")
    if roots is not None:
        odd = df.where(~F.col("root").isin(roots)).select("root").distinct().limit(5).collect()
        if odd:
            raise DataContractError(f"unexpected roots: {odd}")
