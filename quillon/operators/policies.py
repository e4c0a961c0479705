"""Stateful policies: pairs by composed maps of blocks of time, and positions from prototype candidates with one step for batch and stream."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import true
from quillon.sources.lineage import cut, numbered_rows

BLOCK = 2048  # times a block


@dataclass(frozen=True)
class PairRules:
    """A pair opens when its score reaches ``enter``; it is given up when its own score is not positive, at ``most_age``, or below ``leave`` from ``least_age`` on; from then on a pair that beats it by ``hurdle``
    takes its place. Between review times a held pair only ages."""

    roots: tuple[str, ...]
    least_age: int = 0
    most_age: int | None = None
    hurdle: float | None = None
    review: int = 1

    @property
    def pairs(self) -> list[tuple[int, int]]:
        m = len(self.roots)
        return [(i, j) for i in range(m) for j in range(m) if i != j]

    @property
    def ages(self) -> int:
        """Older pairs behave as at this age."""
        return max(self.least_age, self.most_age or 1, 1)

    @property
    def states(self) -> int:
        """0 is no pair, 1 + pair * ages + age - 1 a pair."""
        return 1 + len(self.pairs) * self.ages

    def scores(self, names: list[str], score: list[float], beta: list[float]) -> np.ndarray:
        """Each pair's forecast of the weights that would be held; NaN where an instrument isn't there."""
        at = {n: (s, b) for n, s, b in zip(names, score, beta)}
        out = np.full(len(self.pairs), np.nan)
        for k, (i, j) in enumerate(self.pairs):
            if self.roots[i] in at and self.roots[j] in at:
                (sa, ba), (sb, bb) = at[self.roots[i]], at[self.roots[j]]
                out[k] = (bb * sa - ba * sb) / (ba + bb)
        return out

    def step(self, state: np.ndarray, t: int, worth: np.ndarray, enter: float, leave: float) -> np.ndarray:
        """The states after time number t, for any states before it."""
        held = state > 0
        pair, age = np.where(held, (state - 1) // self.ages, 0), np.where(held, (state - 1) % self.ages + 1, 0)
        own = np.where(held, worth[pair], np.nan)
        older = np.minimum(age + 1, self.ages)
        resting = bool(t % self.review)
        waits = held & resting & (age < self.most_age if self.most_age is not None else True)
        old = self.most_age is not None and age + 1 >= self.most_age
        keep = held & (own > 0) & ~np.asarray(old) & ~((age + 1 >= self.least_age) & (own < leave))  # NaN is not above 0
        best = int(np.argmax(np.where(np.isnan(worth), -np.inf, worth))) if len(worth) and not np.isnan(worth).all() else -1
        after = np.where(keep, 1 + pair * self.ages + older - 1, 0)
        if best >= 0 and worth[best] > 0:
            fresh = 1 + best * self.ages
            opens = ~keep & (worth[best] >= enter)
            swaps = keep & (age + 1 >= self.least_age) & (worth[best] > np.maximum(enter, own + self.hurdle)) if self.hurdle is not None else np.zeros(len(state), bool)
            after = np.where(opens | swaps, fresh, after)
        after = np.where(resting & ~held, 0, after)
        return np.where(waits, 1 + pair * self.ages + older - 1, after)


def _panel(scores: DataFrame, enter: Column, leave: Column) -> tuple[DataFrame, int]:
    """A row a time: i, block, timestamp, x (root, score, beta by name), enter, leave. Thresholds are never negative."""
    floor = lambda c: F.greatest(c.cast("double"), F.lit(0.0))
    rows = scores.withColumns({"q_e": floor(enter), "q_l": floor(leave)}).groupBy("timestamp").agg(F.sort_array(F.collect_list(F.struct("root", "score", "beta"))).alias("x"), F.max("q_e").alias("enter"), F.max("q_l").alias("leave"))
    numbered, n = numbered_rows(rows, ["timestamp"])
    return cut(numbered.withColumn("block", F.expr(f"i div {BLOCK}"))), n


def held_pairs(scores: DataFrame, enter: Column, leave: Column, rules: PairRules) -> DataFrame:
    """timestamp, i, long, short, age, pair_score, long_beta, short_beta of the pair that is held at each time, if any. scores: timestamp, root, score, beta and what the thresholds read.

    The policy is a function on a small state. First every block of times computes where it leads from each state; these maps are composed in order, a lookup a block; then every block walks from its
    own start. No task sees more than a block.
    """
    panel, n = _panel(scores, enter, leave)

    def times(pdf):
        for i, x, e, low in zip(pdf["i"], pdf["x"], pdf["enter"], pdf["leave"]):
            yield int(i), rules.scores([r["root"] for r in x], [r["score"] for r in x], [r["beta"] for r in x]), x, e, low

    def leads(pdf):
        import pandas as pd

        now, back = np.arange(rules.states), np.arange(rules.states)
        for i, worth, _, e, low in times(pdf.sort_values("i")):
            now, inverse = np.unique(rules.step(now, i, worth, e, low), return_inverse=True)
            back = inverse[back]
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "to": [now[back].tolist()]})

    blocks = -(-n // BLOCK)
    starts, now = {}, 0
    if blocks > 1:
        found = {r["block"]: r["to"] for r in panel.where(F.col("block") < blocks - 1).groupBy("block").applyInPandas(leads, "block long, to array<int>").collect()}  # a small map a block
    for b in range(blocks):
        starts[b] = now
        now = found[b][now] if b < blocks - 1 else now

    def walk(pdf):
        import pandas as pd

        pdf, out = pdf.sort_values("i"), []
        state = np.array([starts[int(pdf["block"].iloc[0])]])
        for now, (i, worth, x, e, low) in zip(pdf["timestamp"], times(pdf)):
            state = rules.step(state, i, worth, e, low)
            if s := int(state[0]):
                pair, beta = (s - 1) // rules.ages, {r["root"]: r["beta"] for r in x}
                a, b = (rules.roots[k] for k in rules.pairs[pair])
                out.append((now, i, a, b, (s - 1) % rules.ages + 1, worth[pair], beta.get(a), beta.get(b)))
        return pd.DataFrame(out, columns=["timestamp", "i", "long", "short", "age", "pair_score", "long_beta", "short_beta"])

    return panel.groupBy("block").applyInPandas(walk, "timestamp timestamp, i long, long string, short string, age int, pair_score double, long_beta double, short_beta double")


def roots_of(scores: DataFrame) -> tuple[str, ...]:
    return tuple(r[0] for r in scores.select("root").distinct().orderBy("root").collect())  # a few instruments


def _weights(held: DataFrame, scale: Column) -> DataFrame:
    """timestamp, root, weight: a pair's two weights, of gross one without exposure to the common factor, times the scale."""
    total = F.col("long_beta") + F.col("short_beta")
    sides = F.array(F.struct(F.col("long").alias("root"), (F.col("short_beta") / total).alias("w")), F.struct(F.col("short").alias("root"), (-F.col("long_beta") / total).alias("w")))
    x = held.withColumn("q_s", scale).select("timestamp", "q_s", F.explode(sides).alias("q"))
    return x.select("timestamp", "q.root", (F.col("q.w") * F.col("q_s")).alias("weight"))


def pair_policy(scores: DataFrame, enter: float, leave: float, least_age: int = 0, most_age: int | None = None, hurdle: float | None = None) -> DataFrame:
    """timestamp, root, weight of the pair policy with constant thresholds, reviewed at every time."""
    rules = PairRules(roots_of(scores), least_age, most_age, hurdle)
    return _weights(held_pairs(scores, F.lit(enter), F.lit(leave), rules), F.lit(1.0))


def adaptive_pair_weights(scores: DataFrame, enter: Column, leave: Column, least_age: int = 3, most_age: int = 120, hurdle: float = 0.0004, review: int = 1, deadband: float = 0.0, least_scale: float = 0.05, risk: float = 0.0003) -> DataFrame:
    """timestamp, root, weight, age: thresholds by time, a review clock, and a size that follows the held pair's score: score / max(1.5 enter, risk), one at most and nothing below ``least_scale``.

    Between reviews weights stay. At a review a change of less than ``deadband`` (summed over both sides) is not made. A stay is a spell of one pair without a gap,
    ``most_age`` times unless the same pair is opened again at once, which a fold over the spell resolves.
    """
    rules = PairRules(roots_of(scores), least_age, most_age, hurdle, review)
    limits = cut(scores.withColumn("q_e", F.greatest(enter.cast("double"), F.lit(0.0))).groupBy("timestamp").agg(F.max("q_e").alias("q_e")))
    held = cut(held_pairs(scores, enter, leave, rules).join(limits, "timestamp"))
    total = F.col("long_beta") + F.col("short_beta")
    scale = F.least(F.lit(1.0), F.greatest(F.col("pair_score"), F.lit(0.0)) / F.greatest(F.col("q_e") * 1.5, F.lit(risk)))
    w = W.orderBy("i").partitionBy("long", "short")
    first = F.lag("i").over(w).isNull() | (F.lag("i").over(w) != F.col("i") - 1)
    x = held.withColumns({"q_reviewed": (F.col("i") % review == 0), "q_scale": scale, "q_first": first})
    x = x.withColumn("spell", F.sum(F.col("q_first").cast("int")).over(w))
    small = F.col("q_scale") < least_scale
    point = F.struct("i", "timestamp", "age", (F.col("q_reviewed") | F.col("q_first")).alias("r"), F.when(small, 0.0).otherwise(F.col("q_scale") * F.col("short_beta") / total).alias("a"), F.when(small, 0.0).otherwise(F.col("q_scale") * F.col("long_beta") / total).alias("b"), small.alias("off"))
    spells = x.groupBy("long", "short", "spell").agg(F.array_sort(F.collect_list(point)).alias("p"))
    empty = F.array().cast("array<struct<i:bigint,timestamp:timestamp,age:int,a:double,b:double,off:boolean>>")

    def fold(done: Column, p: Column) -> Column:
        old = F.element_at(done, -1)
        near = (F.size(done) > 0) & ~true(old.off) & (F.abs(p.a - old.a) + F.abs(p.b - old.b) < deadband)
        stays = (F.size(done) > 0) & (~p.r | (near & ~p.off))
        row = lambda a, b, off: F.struct(p.i.alias("i"), p.timestamp.alias("timestamp"), p.age.alias("age"), a.alias("a"), b.alias("b"), off.alias("off"))
        return F.concat(done, F.array(F.when(stays, row(old.a, old.b, F.when(~p.r, F.lit(False)).otherwise(old.off))).otherwise(row(p.a, p.b, p.off))))

    out = spells.select("long", "short", F.explode(F.aggregate("p", empty, fold)).alias("p")).where("p.a <> 0 OR p.b <> 0")
    sides = F.array(F.struct(F.col("long").alias("root"), F.col("p.a").alias("w")), F.struct(F.col("short").alias("root"), (-F.col("p.b")).alias("w")))
    return out.select("p.timestamp", "p.age", F.explode(sides).alias("q")).select("timestamp", "q.root", F.col("q.w").alias("weight"), "age")


def candidates(df: DataFrame, scores: str, enter: list[float], reliability: list[float], direction: list[int], margin: float = 1.25) -> DataFrame:
    """df with signal (-1, 0, 1), selected (the prototype behind it), strength (of both sides together) and conflicting: prototypes of both directions above their entry, none clearly stronger.

    scores: an array column, an entry a prototype. How far a score is above its entry, by reliability, is a prototype's strength.
    """
    def scaled(k: int) -> Column:
        above = F.greatest(F.element_at(scores, k + 1) - enter[k], F.lit(0.0)) / max(1 - enter[k], 0.02)
        return F.least(above * reliability[k], F.lit(1.0))

    side = lambda sign: F.array(*[scaled(k) if d * sign > 0 else F.lit(0.0) for k, d in enumerate(direction)])
    x = df.withColumns({"q_long": side(1), "q_short": side(-1)}).withColumns({"q_l": F.array_max("q_long"), "q_s": F.array_max("q_short")})
    signal = F.when(F.col("q_l") > F.col("q_s") * margin, 1).when(F.col("q_s") > F.col("q_l") * margin, -1).otherwise(0)
    at = lambda side, best: (F.array_position(side, F.col(best)) - 1).cast("int")
    x = x.withColumn("signal", signal).withColumns({
        "selected": F.when(F.col("signal") > 0, at("q_long", "q_l")).when(F.col("signal") < 0, at("q_short", "q_s")).otherwise(-1), "strength": F.col("q_l") + F.col("q_s"),
        "conflicting": (F.col("q_l") > 0) & (F.col("q_s") > 0) & (F.col("signal") == 0),
    })
    return x.drop("q_long", "q_short", "q_l", "q_s")


@dataclass(frozen=True)
class Holding:
    """How positions are held: for ``fixed`` bars, or, without it, until ``most`` bars, a score below its exit from ``least`` bars on, or the opposite signal."""

    leave: tuple[float, ...]
    fixed: int | None = None
    least: int = 4
    most: int = 32

    def step(self, state: tuple[int, int, int], signal: int, selected: int, scores, strength: float) -> tuple[tuple[int, int, int], int]:
        """State (position, age, prototype) and position after one bar."""
        now, age, active = state
        if self.fixed is not None:
            if age >= self.fixed:
                now, age, active = 0, 0, -1
            if now == 0 and signal:
                now, age, active = signal, 0, selected
            return (now, age + 1 if now else age, active), now
        if now:
            age += 1
            faded = age >= self.least and scores[active] < self.leave[active]
            if age >= self.most or faded or (signal == -now and strength > 0):
                now, age, active = 0, 0, -1
        if now == 0 and signal:
            now, age, active = signal, 0, selected
        return (now, age, active), now


def held_positions(df: DataFrame, scores: str, rules: Holding) -> DataFrame:
    """root, timestamp, position, age, prototype along each instrument's bars. df: root, timestamp, the scores' array, signal, selected, strength (``candidates``). The state is three integers an instrument;
    the stream form is ``streaming.bars.stream_positions``."""

    def run(pdf):
        pdf = pdf.sort_values("timestamp")
        return positions_of(pdf, (0, 0, -1), rules)[0]

    x = df.select("root", "timestamp", F.col(scores).alias("scores"), "signal", "selected", "strength")
    return x.groupBy("root").applyInPandas(run, "root string, timestamp timestamp, position int, age int, prototype int")


def positions_of(pdf, state: tuple[int, int, int], rules: Holding):
    """Positions of rows in time order from a state, and the state after them."""
    out = []
    for signal, selected, scores, strength in zip(pdf["signal"], pdf["selected"], pdf["scores"], pdf["strength"]):
        state, now = rules.step(state, int(signal), int(selected), scores, float(strength))
        out.append((now, state[1], state[2]))
    cols = list(zip(*out)) if out else [[], [], []]
    return pdf[["root", "timestamp"]].assign(position=np.array(cols[0], int), age=np.array(cols[1], int), prototype=np.array(cols[2], int)), state
