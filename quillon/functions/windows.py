"""Windows over ordered bars: strict frames, fills, ranks, bins and runs.

Every window orders by a unique key, so results don't depend on the plan. A strict aggregate is NULL unless its whole frame is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Bars:
    """Window expressions for one partition key and order, so that all of them share one sort."""

    def __init__(self, by: list[str] | str, order: list[str] | str):
        self.by, self.order = [by] if isinstance(by, str) else list(by), [order] if isinstance(order, str) else list(order)
        self.w: WindowSpec = W.partitionBy(*self.by).orderBy(*self.order)

    def frame(self, first: int, last: int) -> WindowSpec:
        return self.w.rowsBetween(first, last)

    def strict(self, agg, x: Column, n: int, back: int = 0, least: int | None = None) -> Column:
        """agg over n rows that end ``back`` rows before the current one, if at least ``least`` (all) are there."""
        w = self.frame(-(n - 1) - back, -back)
        return F.when(F.count(x).over(w) >= (n if least is None else least), agg(x).over(w))

    def sum(self, x: Column, n: int, **k) -> Column:
        return self.strict(F.sum, x, n, **k)

    def mean(self, x: Column, n: int, **k) -> Column:
        return self.strict(F.avg, x, n, **k)

    def max(self, x: Column, n: int, **k) -> Column:
        return self.strict(F.max, x, n, **k)

    def min(self, x: Column, n: int, **k) -> Column:
        return self.strict(F.min, x, n, **k)

    def var(self, x: Column, n: int, **k) -> Column:
        return self.strict(F.var_samp, x, n, **k)

    def median(self, x: Column, n: int, **k) -> Column:
        return self.strict(lambda y: F.percentile(y, 0.5), x, n, **k)

    def corr(self, x: Column, y: Column, n: int) -> Column:
        """Pairs must all be there; NULL where a side is constant."""
        w = self.frame(-(n - 1), 0)
        both = F.when(x.isNotNull() & y.isNotNull(), 1)
        value = F.corr(x, y).over(w)
        return F.when((F.count(both).over(w) == n) & ~F.isnan(value), value)

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.w) if n >= 0 else F.lead(x, -n).over(self.w)

    def diff(self, x: Column, n: int = 1) -> Column:
        return x - self.lag(x, n)

    def ahead(self, agg, x: Column, first: int, last: int) -> Column:
        """agg over following rows first to last, if all are there."""
        w = self.frame(first, last)
        return F.when(F.count(x).over(w) == last - first + 1, agg(x).over(w))

    def expanding(self, agg, x: Column, least: int, back: int = 0) -> Column:
        w = self.w.rowsBetween(W.unboundedPreceding, -back)
        return F.when(F.count(x).over(w) >= least, agg(x).over(w))

    def running(self, agg, x: Column) -> Column:
        return agg(x).over(self.w.rowsBetween(W.unboundedPreceding, 0))

    def ffill(self, x: Column) -> Column:
        return F.last(x, ignorenulls=True).over(self.w.rowsBetween(W.unboundedPreceding, 0))

    def number(self) -> Column:
        """0, 1, 2 ..."""
        return F.row_number().over(self.w) - 1

    def run_id(self, x: Column) -> Column:
        """To be computed in two steps: the flag where x changes, of which running() sums."""
        before = self.lag(x)
        return F.when(before.isNull() & x.isNull() | (before == x), 0).otherwise(1)

    def share_below(self, x: Column, n: int, least: int) -> Column:
        """Share of the n - 1 values before that are at most the current one."""
        w = self.frame(-(n - 1), 0)
        earlier = F.filter(F.collect_list(x).over(self.frame(-(n - 1), -1)), lambda v: v.isNotNull())
        part = F.size(F.filter(earlier, lambda v: v <= x)) / F.nullif(F.size(earlier), F.lit(0))
        return F.when(x.isNotNull() & (F.count(x).over(w) >= least), part)


def average_rank(x: Column, by: list[str]) -> Column:
    """Rank with ties sharing their mean."""
    same = W.partitionBy(*by, x)
    return F.rank().over(W.partitionBy(*by).orderBy(x)) + (F.count("*").over(same) - 1) / 2


def equal_bins(rank: Column, n: Column, k: int) -> Column:
    """Bin 0 to k - 1 of a rank 1 to n: equal counts by interpolated quantiles of the ranks."""
    return F.greatest(F.floor((((rank - 1) * k + n - 2) / F.greatest(n - 1, F.lit(1)))).cast("long") - 1, F.lit(0).cast("long"))


def ewms(df: DataFrame, by: list[str], order: list[str], means: dict[str, tuple]) -> DataFrame:
    """Recursive exponential means: every row ages the weight, an observed row renews it; NULL until enough values are there.

    means: out -> (value, least, and one of span, halflife, alpha as a dict). ``by`` and ``order`` together are unique. The recursion is sequential in a key, so this is a grouped map by key;
    only key, order and values travel to it, once for all means, and what it gives is joined to the other columns. A very long series is given finer keys, or a warm start, by the caller.
    """
    values = sorted({v for v, _, _ in means.values()})
    schema = T.StructType([*[df.schema[c] for c in (*by, *order)], *[T.StructField(n, T.DoubleType()) for n in means]])

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        for out, (value, least, decay) in means.items():
            pdf[out] = pdf[value].astype(float).ewm(**decay, adjust=False, min_periods=least).mean()
        return pdf[[*by, *order, *means]]

    found = df.select(*by, *order, *[v for v in values if v not in (*by, *order)]).groupBy(*by).applyInPandas(run, schema)
    return df.join(found.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in means}), [*by, *order], "left")


def ewm(df: DataFrame, by: list[str], order: list[str], value: str, out: str, least: int, span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> DataFrame:
    """One mean of ``ewms``."""
    return ewms(df, by, order, {out: (value, least, {k: v for k, v in (("span", span), ("halflife", halflife), ("alpha", alpha)) if v is not None})})


class Ordered:
    """A growing multiset of numbers with exact quantiles: sorted blocks that are split when they get long, so an insertion moves a block's numbers and not all of them."""

    LONG = 2048

    def __init__(self):
        self.blocks, self.tops, self.n = [], [], 0

    def add(self, x: float) -> None:
        from bisect import bisect_left, insort

        if not self.blocks:
            self.blocks, self.tops = [[x]], [x]
        else:
            i = min(bisect_left(self.tops, x), len(self.tops) - 1)
            block = self.blocks[i]
            insort(block, x)
            self.tops[i] = block[-1]
            if len(block) > self.LONG:
                half = len(block) // 2
                self.blocks[i : i + 1] = [block[:half], block[half:]]
                self.tops[i : i + 1] = [block[half - 1], block[-1]]
        self.n += 1

    def at(self, k: int) -> float:
        for block in self.blocks:
            if k < len(block):
                return block[k]
            k -= len(block)
        raise IndexError(k)

    def quantile(self, q: float) -> float:
        """Linear between the neighbours, as percentile() has it."""
        place = q * (self.n - 1)
        low = int(place)
        a = self.at(low)
        return a if place == low else a + (place - low) * (self.at(low + 1) - a)


def expanding_quantiles(df: DataFrame, by: list[str], order: list[str], value: str, quantiles: dict[str, float], least: int) -> DataFrame:
    """df and, for each out -> q, the exact quantile of all earlier rows' values of the key; NULL until ``least`` of them are there.

    ``by`` and ``order`` together are unique. A window would sort each row's whole history again; here a key's rows pass once through one growing sorted list (key, order and value only), which takes
    n log n steps and the memory of one key's values.
    """
    schema = T.StructType([*[df.schema[c] for c in (*by, *order)], *[T.StructField(n, T.DoubleType()) for n in quantiles]])

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values(order, kind="stable")
        x, seen = pdf[value].to_numpy(float), Ordered()
        found = np.full((len(quantiles), len(x)), np.nan)
        for i, v in enumerate(x):
            if seen.n >= least and seen.n:
                for j, q in enumerate(quantiles.values()):
                    found[j, i] = seen.quantile(q)
            if v == v:
                seen.add(v)
        out = pdf[[*by, *order]].copy()
        for n, values in zip(quantiles, found):
            out[n] = values
        return out

    found = df.select(*by, *order, value).groupBy(*by).applyInPandas(run, schema)
    return df.join(found.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in quantiles}), [*by, *order], "left")


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds run (1, 2, ...) and age (0, 1, ...) of spells of an unchanged value."""
    bars = Bars(by, order)
    marked = df.withColumn("q_new", bars.run_id(F.col(value)))
    numbered = marked.withColumn("run", bars.running(F.sum, F.col("q_new")))
    return numbered.withColumn("age", Bars([*by, "run"], order).number()).drop("q_new")
