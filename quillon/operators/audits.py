"""How a policy earns: survival of holdings, other exits from the same entries, forecasts by gap, and how many states are enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import log
from quillon.functions.windows import Bars, equal_bins, runs
from quillon.operators.selection import block_sums
from quillon.operators.stats import beside
from quillon.sources.lineage import cut, numbered_rows


def spells(df: DataFrame, position: str = "position") -> DataFrame:
    """root, spell, side, bars, opened, closed (its last bar), censored (it lasts to the instrument's last bar, so its end isn't known) of every spell of one sign of the position."""
    x = runs(df.withColumn("side", F.signum(position).cast("int")), ["root"], ["timestamp"], "side")
    last = df.groupBy("root").agg(F.max("timestamp").alias("q_last"))
    x = x.where("side <> 0").groupBy("root", "run", "side").agg(F.count("*").alias("bars"), F.min("timestamp").alias("opened"), F.max("timestamp").alias("closed"))
    return x.join(last, "root").select("root", F.col("run").alias("spell"), "side", "bars", "opened", "closed", (F.col("closed") == F.col("q_last")).alias("censored"))


def survival(held: DataFrame, by: list[str]) -> DataFrame:
    """by, age, at_risk, ended, survival: the share of holdings that outlast each age at which one ends (Kaplan and Meier). A censored holding counts as at risk up to its age and never as ended."""
    ages = held.groupBy(*by, F.col("bars").alias("age")).agg(F.count("*").alias("q_n"), F.count_if(~F.col("censored")).alias("ended"))
    down, up = W.partitionBy(*by).orderBy(F.desc("age")), W.partitionBy(*by).orderBy("age")  # a row an age
    x = ages.withColumn("at_risk", F.sum("q_n").over(down))
    gone = F.max((F.col("ended") == F.col("at_risk")).cast("int")).over(up) == 1
    kept = F.exp(F.sum(F.coalesce(log(1 - F.col("ended") / F.col("at_risk")), F.lit(0.0))).over(up))
    return x.withColumn("survival", F.when(gone, 0.0).otherwise(kept)).where("ended > 0").select(*by, "age", "at_risk", "ended", "survival")


def same_entries(held: DataFrame, prices: DataFrame, fixed: int) -> DataFrame:
    """root, entries and mean log returns from the same entries of three policies: the own exit, ``fixed`` bars, and the opposite side for the own time. held: ``spells``; prices: root, timestamp, close.

    An entry is a spell's first close; the own exit is the bar after its last. Entries without a price at either exit are left out for all three, so the policies are compared on the same entries.
    """
    w = Bars("root", "timestamp")
    p = prices.select("root", "timestamp", log(F.col("close")).alias("lc")).withColumns({"q_next": w.lag(F.col("lc"), -1), "q_far": w.lag(F.col("lc"), -fixed)})
    entry = p.select("root", F.col("timestamp").alias("opened"), "lc", "q_far")
    leave = p.select("root", F.col("timestamp").alias("closed"), "q_next")
    x = held.join(entry, ["root", "opened"]).join(leave, ["root", "closed"]).dropna(subset=["q_next", "q_far", "lc"])
    own, far = F.col("side") * (F.col("q_next") - F.col("lc")), F.col("side") * (F.col("q_far") - F.col("lc"))
    return x.groupBy("root").agg(F.count("*").alias("entries"), F.avg(own).alias("own_exit"), F.avg(far).alias("fixed_exit"), F.avg(-own).alias("opposite_side"), F.avg("bars").alias("mean_bars"))


def gap_bins(df: DataFrame, gap: str, values: dict[str, Column], order: list[str], bins: int = 5) -> DataFrame:
    """bin (from 1), rows, mean gap and means of ``values`` over equal-count bins of the gap; equal gaps by ``order``. Ranks are numbers in sorted ranges."""
    x, n = numbered_rows(df.where(F.col(gap).isNotNull()), [gap, *order])
    at = equal_bins(F.col("i") + 1, F.lit(n), bins).cast("int") + 1
    return x.groupBy(at.alias("bin")).agg(F.count("*").alias("rows"), F.avg(gap).alias("mean_gap"), *[F.avg(v).alias(k) for k, v in values.items()])


def smallest_within(losses: DataFrame, block: int, draws: int, seed: int, alpha: float = 0.05, day: str = "day") -> DataFrame:
    """k, loss, difference, low, high, best, chosen: mean daily loss of each size, its paired difference to the best with an interval by blocks of days, and the smallest size whose interval reaches the best.

    losses: k, day, loss, a row a forecast or a day. Every size sees the same draws: all are sums over one table of days.
    """
    daily = cut(losses.groupBy("k", day).agg(F.avg("loss").alias("l")))
    mean = daily.groupBy("k").agg(F.avg("l").alias("loss"))
    sizes = [r["k"] for r in mean.orderBy("k").collect()]  # a few sizes
    best = mean.orderBy(F.round("loss", 12), "k").first()["k"]
    wide = daily.groupBy(day).pivot("k", sizes).agg(F.first("l")).select(day, *[(F.col(str(k)) - F.col(str(best))).alias(f"d{k}") for k in sizes])
    drawn = block_sums(wide, [f"d{k}" for k in sizes], day, block, draws, seed)
    q = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    bands = drawn.agg(*[F.percentile(F.col(f"d{k}") / F.col("days"), q).alias(f"q{k}") for k in sizes])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"q{k}")[0].alias("low"), F.col(f"q{k}")[1].alias("high")) for k in sizes])
    x = mean.join(bands.select(F.explode(rows).alias("x")).select("x.*"), "k")
    x = beside(x, mean.where(F.col("k") == best).select(F.col("loss").alias("q_best")))
    x = x.withColumn("q_ok", F.col("low") <= 0)
    chosen = x.where("q_ok").agg(F.min("k").alias("q_chosen"))
    x = beside(x, chosen)
    return x.select("k", "loss", (F.col("loss") - F.col("q_best")).alias("difference"), "low", "high", (F.col("k") == best).alias("best"), (F.col("k") == F.col("q_chosen")).alias("chosen"))
