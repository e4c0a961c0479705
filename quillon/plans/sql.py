"""What the SQL oracles share."""

from __future__ import annotations

BARS = """
ticks AS (SELECT event_type AS root, ts, event_id, 100.0 + value AS price, (1 + user_id % 5)::DOUBLE AS volume,
                 CASE WHEN event_id % 2 = 0 THEN (1 + user_id % 5)::DOUBLE ELSE 0.0 END AS taker FROM events),
bars AS (SELECT root, date_trunc('hour', ts) AS timestamp, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
                last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume, sum(price * volume) AS quote, sum(price * taker) AS taker_quote, count(*) AS bar_count,
                sum(price * volume) / sum(volume) AS wap, count(*) >= 2 AS is_valid, date_trunc('hour', ts)::DATE AS session_id,
                root || '-' || floor((day(date_trunc('hour', ts)) - 1) / 10.0)::INT AS local_symbol
         FROM ticks GROUP BY root, date_trunc('hour', ts))"""

W = "PARTITION BY root ORDER BY timestamp"


def strict(agg: str, x: str, n: int, back: int = 0, least: int | None = None, w: str = W) -> str:
    frame = f"OVER ({w} ROWS BETWEEN {n - 1 + back} PRECEDING AND {back} PRECEDING)"
    return f"CASE WHEN count({x}) {frame} >= {n if least is None else least} THEN {agg}({x}) {frame} END"


def lag(x: str, n: int = 1, w: str = W) -> str:
    return f"lag({x}, {n}) OVER ({w})" if n >= 0 else f"lead({x}, {-n}) OVER ({w})"


def ln(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"


def ewm(x: str, alpha: str, least: int, w: str = W) -> str:
    """Closed form of the recursion, for a column without nulls and an index t from 0."""
    return (
        f"CASE WHEN t >= {least - 1} THEN pow(1 - {alpha}, t) * (first_value({x}) OVER ({w}) + {alpha} * sum(CASE WHEN t > 0 THEN {x} * pow(1 - {alpha}, -t) ELSE 0 END) "
        f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END"
    )


#: Returns of bars_r: bars with is_roll_boundary, ret, overnight_ret.
RETURNS = f"""{BARS},
bars_r AS (SELECT *, {lag('local_symbol')} IS NOT NULL AND {lag('local_symbol')} <> local_symbol AS is_roll_boundary,
    CASE WHEN is_valid AND {lag('is_valid')} AND {lag('local_symbol')} = local_symbol AND {lag('session_id')} = session_id THEN ln(close / {lag('close')}) END AS ret,
    CASE WHEN is_valid AND {lag('is_valid')} AND {lag('local_symbol')} = local_symbol AND {lag('session_id')} <> session_id THEN ln(close / {lag('close')}) END AS overnight_ret
    FROM bars)"""


def rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)
