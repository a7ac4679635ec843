"""DuckDB twins of the catalogue's queries, put together from named parts."""

from __future__ import annotations

import re

from ..functions import resample
from .config import WEIGHTS

_TICK_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"

#: Parts by name, each in terms of tables and other parts.
PARTS: dict[str, str] = {
    "bars": f"""
      SELECT symbol, ts, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS INTEGER) AS i, open, high, low, close, volume FROM (
        SELECT p_brand AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, first(px ORDER BY {_TICK_ORDER}) AS open, max(px) AS high,
               min(px) AS low, last(px ORDER BY {_TICK_ORDER}) AS close, sum(l_quantity) AS volume
        FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL)""",
    "moves": """
      SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
             CASE WHEN i > 0 THEN greatest(close - pc, 0) END AS gain, CASE WHEN i > 0 THEN greatest(pc - close, 0) END AS loss,
             CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pm,
             CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mm
      FROM (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i))""",
    "means": """
      SELECT symbol, i, close AS e12, close AS e26, close AS e20, close AS e50, close AS e200, CAST(0 AS DOUBLE) AS sig, CAST(gain AS DOUBLE) AS g,
             CAST(loss AS DOUBLE) AS l, tr AS atr, CAST(pm AS DOUBLE) AS p, CAST(mm AS DOUBLE) AS m, CAST(NULL AS DOUBLE) AS adx, 0 AS k
      FROM moves WHERE i = 0
      UNION ALL
      SELECT symbol, i, e12, e26, e20, e50, e200, 0.8::DOUBLE * sig + 0.2::DOUBLE * (e12 - e26), g, l, atr, p, m,
             CASE WHEN dx IS NULL THEN adx WHEN adx IS NULL THEN dx
                  ELSE (pow(13 / 14::DOUBLE, k + 1) * adx + dx / 14::DOUBLE) / (pow(13 / 14::DOUBLE, k + 1) + 1 / 14::DOUBLE) END,
             CASE WHEN dx IS NULL THEN k + 1 ELSE 0 END
      FROM (SELECT *, CASE WHEN p + m > 0 AND atr > 0 THEN 100 * abs(100 * p / atr - 100 * m / atr) / (100 * p / atr + 100 * m / atr) END AS dx
        FROM (SELECT x.symbol, x.i, r.sig, r.adx, r.k,
                r.e12 * (11 / 13::DOUBLE) + x.close * (2 / 13::DOUBLE) AS e12, r.e26 * (25 / 27::DOUBLE) + x.close * (2 / 27::DOUBLE) AS e26,
                r.e20 * (19 / 21::DOUBLE) + x.close * (2 / 21::DOUBLE) AS e20, r.e50 * (49 / 51::DOUBLE) + x.close * (2 / 51::DOUBLE) AS e50,
                r.e200 * (199 / 201::DOUBLE) + x.close * (2 / 201::DOUBLE) AS e200,
                coalesce(r.g * (13 / 14::DOUBLE) + x.gain / 14::DOUBLE, x.gain) AS g, coalesce(r.l * (13 / 14::DOUBLE) + x.loss / 14::DOUBLE, x.loss) AS l,
                r.atr * (13 / 14::DOUBLE) + x.tr / 14::DOUBLE AS atr, r.p * (13 / 14::DOUBLE) + x.pm / 14::DOUBLE AS p, r.m * (13 / 14::DOUBLE) + x.mm / 14::DOUBLE AS m
              FROM means r JOIN moves x ON x.symbol = r.symbol AND x.i = r.i + 1))""",
    "ind": """
      SELECT b.*, coalesce(CASE WHEN b.i >= 14 AND r.l <> 0 THEN 100 - 100 / (1 + r.g / r.l) END, 50) AS rsi, e12 - e26 AS macd_line, sig AS macd_signal,
             e12 - e26 - sig AS macd_hist, e20 AS ema20, e50 AS ema50, e200 AS ema200, coalesce(adx, 0) AS adx,
             CASE WHEN atr = 0 THEN 0 ELSE 100 * p / atr END AS plus_di, CASE WHEN atr = 0 THEN 0 ELSE 100 * m / atr END AS minus_di, atr
      FROM bars b JOIN means r ON b.symbol = r.symbol AND b.i = r.i""",
    "raw_swings": """
      SELECT symbol, i, ts, kind, price, seq, i + 3 AS conf_i FROM (
        SELECT *, max(high) OVER b AS hb, max(high) OVER a AS ha, min(low) OVER b AS lb, min(low) OVER a AS la, count(*) OVER b AS nb, count(*) OVER a AS na
        FROM bars WINDOW b AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
                         a AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
        LATERAL (SELECT 'high' AS kind, high AS price, 2 * i AS seq WHERE high > hb AND high > ha
                 UNION ALL SELECT 'low', low, 2 * i + 1 WHERE low < lb AND low < la) WHERE nb = 3 AND na = 3""",
    "swings": """
      SELECT *, CASE WHEN before IS NULL THEN NULL WHEN kind = 'high' THEN CASE WHEN price > before THEN 'HH' ELSE 'LH' END
                     ELSE CASE WHEN price > before THEN 'HL' ELSE 'LL' END END AS label
      FROM (SELECT *, lag(price) OVER (PARTITION BY symbol, kind ORDER BY seq) AS before FROM (
        SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY CASE WHEN kind = 'high' THEN price ELSE -price END DESC, seq DESC) AS rn FROM (
          SELECT *, sum(turn) OVER (PARTITION BY symbol ORDER BY seq) AS run FROM (
            SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY symbol ORDER BY seq) = kind THEN 0 ELSE 1 END AS turn FROM raw_swings))) WHERE rn = 1)""",
    "breaks": """
      SELECT *, CASE WHEN lag(side) OVER w IS NULL OR lag(side) OVER w = side THEN 'BOS' ELSE 'CHoCH' END AS type FROM (
        SELECT s.symbol, min(b.i) AS i, arg_min(b.close, b.i) AS price, CASE WHEN s.kind = 'high' THEN 'bullish' ELSE 'bearish' END AS side,
               s.price AS broken_level, s.i AS broken_i
        FROM (SELECT *, lead(conf_i) OVER (PARTITION BY symbol, kind ORDER BY seq) AS until FROM swings) s
        JOIN bars b ON b.symbol = s.symbol AND b.i >= s.conf_i AND b.i < coalesce(s.until, 1000000000)
          AND CASE WHEN s.kind = 'high' THEN b.close > s.price ELSE b.close < s.price END
        GROUP BY s.symbol, s.kind, s.price, s.i) WINDOW w AS (PARTITION BY symbol ORDER BY i)""",
    "obs0": """
      SELECT symbol, start_i, side, min(event_i) AS event_i, any_value(top) AS top, any_value(bottom) AS bottom FROM (
        SELECT e.symbol, e.i AS event_i, e.side, max(b.i) AS start_i, arg_max(b.high, b.i) AS top, arg_max(b.low, b.i) AS bottom
        FROM breaks e JOIN bars b ON b.symbol = e.symbol AND b.i >= e.broken_i AND b.i < e.i
          AND CASE WHEN e.side = 'bullish' THEN b.close < b.open ELSE b.close > b.open END
        GROUP BY e.symbol, e.i, e.side) GROUP BY symbol, start_i, side""",
    "obs": """
      SELECT o.symbol, o.start_i, o.side, o.event_i, o.top, o.bottom, min(b.i) AS mitigated_i FROM obs0 o
      LEFT JOIN bars b ON b.symbol = o.symbol AND b.i > o.event_i AND b.low <= o.top AND b.high >= o.bottom GROUP BY ALL""",
    "gaps0": """
      SELECT symbol, i - 2 AS start_i, i AS end_i, CASE WHEN h1 < low THEN 'bullish' ELSE 'bearish' END AS side,
             CASE WHEN h1 < low THEN low ELSE l1 END AS top, CASE WHEN h1 < low THEN h1 ELSE high END AS bottom, CASE WHEN h1 < low THEN h1 ELSE l1 END AS ref, atr
      FROM (SELECT *, lag(high, 2) OVER w AS h1, lag(low, 2) OVER w AS l1 FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY i)) WHERE h1 < low OR l1 > high""",
    "gaps": """
      SELECT g.symbol, g.start_i, g.end_i, g.side, g.top, g.bottom, min(b.i) AS filled_i
      FROM (SELECT * FROM gaps0 WHERE atr <= 0 OR (top - bottom) / atr >= 0.5) g
      LEFT JOIN bars b ON b.symbol = g.symbol AND b.i > g.end_i AND CASE WHEN g.side = 'bullish' THEN b.low <= g.top ELSE b.high >= g.bottom END
      GROUP BY g.symbol, g.start_i, g.end_i, g.side, g.top, g.bottom""",
    "pools": """
      SELECT p.symbol, a_i, b_i, price, kind, p.conf_i, min(b.i) AS swept_i FROM (
        SELECT a.symbol, a.i AS a_i, b.i AS b_i, (a.price + b.price) / 2 AS price, CASE WHEN a.kind = 'high' THEN 'EQH' ELSE 'EQL' END AS kind,
               greatest(a.conf_i, b.conf_i) AS conf_i
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY seq) AS n FROM swings) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY seq) AS n FROM swings) b
          ON a.symbol = b.symbol AND a.kind = b.kind AND b.n - a.n BETWEEN 1 AND 3
        WHERE abs(a.price - b.price) / ((a.price + b.price) / 2) <= 0.0015) p
      LEFT JOIN bars b ON b.symbol = p.symbol AND b.i > p.conf_i AND CASE WHEN kind = 'EQH' THEN b.high > price ELSE b.low < price END
      GROUP BY p.symbol, a_i, b_i, price, kind, p.conf_i""",
    "zones": """
      SELECT symbol, i, greatest(h, l) AS top, least(h, l) AS bottom, (greatest(h, l) + least(h, l)) / 2 AS mid,
             CASE WHEN close > (greatest(h, l) + least(h, l)) / 2 THEN 'premium' WHEN close < (greatest(h, l) + least(h, l)) / 2 THEN 'discount' ELSE 'equilibrium' END AS zone
      FROM (SELECT b.symbol, b.i, b.close, last_value(h.price IGNORE NULLS) OVER w AS h, last_value(l.price IGNORE NULLS) OVER w AS l FROM bars b
        LEFT JOIN (SELECT symbol, conf_i, price FROM swings WHERE kind = 'high') h ON h.symbol = b.symbol AND h.conf_i = b.i
        LEFT JOIN (SELECT symbol, conf_i, price FROM swings WHERE kind = 'low') l ON l.symbol = b.symbol AND l.conf_i = b.i
        WINDOW w AS (PARTITION BY b.symbol ORDER BY b.i)) WHERE h IS NOT NULL AND l IS NOT NULL""",
    "recent": """
      SELECT *, min(low) OVER w AS rmin, max(high) OVER w AS rmax, min(i) OVER w AS r_first FROM ind
      WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "components": """
      SELECT r.symbol, r.i,
        CAST(coalesce(z.zone = 'discount', false) AS INTEGER) AS bull_zone, CAST(coalesce(z.zone = 'premium', false) AS INTEGER) AS bear_zone,
        CAST(coalesce(o.bull, 0) AS INTEGER) AS bull_order_block, CAST(coalesce(o.bear, 0) AS INTEGER) AS bear_order_block,
        CAST(coalesce(g.bull, 0) AS INTEGER) AS bull_fvg, CAST(coalesce(g.bear, 0) AS INTEGER) AS bear_fvg,
        CAST(coalesce(e.i >= r.r_first AND e.type = 'CHoCH' AND e.side = 'bullish', false) AS INTEGER) AS bull_choch,
        CAST(coalesce(e.i >= r.r_first AND e.type = 'CHoCH' AND e.side = 'bearish', false) AS INTEGER) AS bear_choch,
        CAST(coalesce(e.i >= r.r_first AND e.type = 'BOS' AND e.side = 'bullish', false) AS INTEGER) AS bull_bos,
        CAST(coalesce(e.i >= r.r_first AND e.type = 'BOS' AND e.side = 'bearish', false) AS INTEGER) AS bear_bos,
        CAST(coalesce(s.bull, 0) AS INTEGER) AS bull_sweep, CAST(coalesce(s.bear, 0) AS INTEGER) AS bear_sweep,
        CAST(rsi > 50 AS INTEGER) AS bull_rsi, CAST(rsi < 50 AS INTEGER) AS bear_rsi, CAST(macd_hist > 0 AS INTEGER) AS bull_macd, CAST(macd_hist < 0 AS INTEGER) AS bear_macd,
        CAST(ema20 > ema50 AND ema50 > ema200 AS INTEGER) AS bull_ema_stack, CAST(ema20 < ema50 AND ema50 < ema200 AS INTEGER) AS bear_ema_stack,
        CAST(adx >= 20 AND plus_di > minus_di AS INTEGER) AS bull_adx_di, CAST(adx >= 20 AND plus_di <= minus_di AS INTEGER) AS bear_adx_di
      FROM recent r LEFT JOIN zones z ON z.symbol = r.symbol AND z.i = r.i
      LEFT JOIN (SELECT r.symbol, r.i, max(CAST(side = 'bullish' AS INTEGER)) AS bull, max(CAST(side = 'bearish' AS INTEGER)) AS bear FROM recent r JOIN obs o
        ON o.symbol = r.symbol AND o.event_i <= r.i AND coalesce(o.mitigated_i, 1000000000) > r.i AND rmin <= o.top AND rmax >= o.bottom GROUP BY ALL) o ON o.symbol = r.symbol AND o.i = r.i
      LEFT JOIN (SELECT r.symbol, r.i, max(CAST(side = 'bullish' AS INTEGER)) AS bull, max(CAST(side = 'bearish' AS INTEGER)) AS bear FROM recent r JOIN gaps o
        ON o.symbol = r.symbol AND o.end_i <= r.i AND coalesce(o.filled_i, 1000000000) > r.i AND rmin <= o.top AND rmax >= o.bottom GROUP BY ALL) g ON g.symbol = r.symbol AND g.i = r.i
      LEFT JOIN (SELECT r.symbol, r.i, max(CAST(kind = 'EQL' AND close > price AS INTEGER)) AS bull, max(CAST(kind = 'EQH' AND close < price AS INTEGER)) AS bear
        FROM recent r JOIN pools p ON p.symbol = r.symbol AND p.swept_i BETWEEN r.i - 2 AND r.i GROUP BY ALL) s ON s.symbol = r.symbol AND s.i = r.i
      ASOF LEFT JOIN breaks e ON e.symbol = r.symbol AND e.i <= r.i""",
    "scores": """
      SELECT symbol, i, CAST(15 * bull_zone + 15 * bull_order_block + 10 * bull_fvg + 15 * bull_choch + 8 * bull_bos + 7 * bull_sweep + 5 * (bull_rsi + bull_macd + bull_ema_stack + bull_adx_di) AS INTEGER) AS bull_score,
             CAST(15 * bear_zone + 15 * bear_order_block + 10 * bear_fvg + 15 * bear_choch + 8 * bear_bos + 7 * bear_sweep + 5 * (bear_rsi + bear_macd + bear_ema_stack + bear_adx_di) AS INTEGER) AS bear_score
      FROM components""",
    "filled": """
      SELECT *, CASE WHEN o1 <= limit_price THEN o1 WHEN l1 <= limit_price THEN limit_price WHEN limit_price IS NOT NULL AND o2 IS NOT NULL THEN o2 ELSE close END AS entry_px,
             CASE WHEN o1 <= limit_price OR l1 <= limit_price THEN 0 WHEN limit_price IS NOT NULL AND o2 IS NOT NULL THEN 1 ELSE -1 END AS entry_off
      FROM (SELECT *, CASE WHEN atr > 0 THEN close - 0.5::DOUBLE * atr END AS limit_price, lead(open) OVER w AS o1, lead(low) OVER w AS l1, lead(open, 2) OVER w AS o2
            FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY i))""",
    "planned": """
      SELECT *, CASE WHEN ok AND entry_px > ls THEN ls END AS long_stop, CASE WHEN ok AND ss > entry_px THEN ss END AS short_stop,
             CASE WHEN ok AND entry_px > ls THEN CASE WHEN (up - entry_px) / (entry_px - ls) BETWEEN 0.5 AND 10 THEN up ELSE entry_px + 2 * (entry_px - ls) END END AS long_target,
             CASE WHEN ok AND ss > entry_px THEN CASE WHEN (entry_px - down) / (ss - entry_px) BETWEEN 0.5 AND 10 THEN down ELSE entry_px - 2 * (ss - entry_px) END END AS short_target
      FROM (SELECT f.*, atr > 0 AND entry_px > 0 AS ok, up, down,
              CASE WHEN under - 0.25::DOUBLE * atr < entry_px THEN under - 0.25::DOUBLE * atr ELSE entry_px - 1.5::DOUBLE * atr END AS ls,
              CASE WHEN over_ + 0.25::DOUBLE * atr > entry_px THEN over_ + 0.25::DOUBLE * atr ELSE entry_px + 1.5::DOUBLE * atr END AS ss
        FROM filled f
        LEFT JOIN (SELECT f.symbol, f.i, max(CASE WHEN side = 'bullish' AND bottom < entry_px THEN bottom END) AS under, min(CASE WHEN side = 'bearish' AND top > entry_px THEN top END) AS over_
          FROM filled f JOIN obs o ON o.symbol = f.symbol AND o.event_i <= f.i AND coalesce(o.mitigated_i, 1000000000) > f.i GROUP BY ALL) o ON o.symbol = f.symbol AND o.i = f.i
        LEFT JOIN (SELECT f.symbol, f.i, min(CASE WHEN kind = 'EQH' AND price > entry_px THEN price END) AS up, max(CASE WHEN kind = 'EQL' AND price < entry_px THEN price END) AS down
          FROM filled f JOIN pools p ON p.symbol = f.symbol AND p.conf_i <= f.i AND coalesce(p.swept_i, 1000000000) > f.i GROUP BY ALL) p ON p.symbol = f.symbol AND p.i = f.i)""",
}
for _side, _sign in (("long", 1), ("short", -1)):
    _hit = ("b.low <= s.long_stop", "b.high >= s.long_target") if _sign > 0 else ("b.high >= s.short_stop", "b.low <= s.short_target")
    PARTS[f"exits_{_side}"] = f"""
      SELECT symbol, i, entry_px, stop, target, CASE WHEN js IS NOT NULL AND (jw IS NULL OR js <= jw) THEN 'stop' WHEN jw IS NOT NULL THEN 'target' ELSE 'timeout' END AS outcome,
             CASE WHEN js IS NOT NULL AND (jw IS NULL OR js <= jw) THEN js WHEN jw IS NOT NULL THEN jw ELSE je END AS bars_held,
             {_sign} * (CASE WHEN js IS NOT NULL AND (jw IS NULL OR js <= jw) THEN stop WHEN jw IS NOT NULL THEN target ELSE ce END - entry_px) / entry_px AS ret, entry_off
      FROM (SELECT s.symbol, s.i, s.entry_px, s.entry_off, s.{_side}_stop AS stop, s.{_side}_target AS target, min(CASE WHEN {_hit[0]} THEN b.i - s.i - s.entry_off - 1 END) AS js,
              min(CASE WHEN {_hit[1]} THEN b.i - s.i - s.entry_off - 1 END) AS jw, max(b.i - s.i - s.entry_off - 1) AS je, arg_max(b.close, b.i) AS ce
            FROM planned s JOIN bars b ON b.symbol = s.symbol AND b.i BETWEEN s.i + s.entry_off + 2 AND s.i + s.entry_off + 21
            WHERE s.{_side}_stop IS NOT NULL GROUP BY ALL)"""
PARTS["wf"] = """
  SELECT p.symbol, p.i, p.ts, p.entry_off, p.entry_px, s.bull_score, s.bear_score, coalesce(l.ret, 0) AS long_ret, CAST(coalesce(greatest(l.bars_held + p.entry_off + 1, 1), 5) AS INTEGER) AS long_bars,
         coalesce(l.outcome, 'none') AS long_outcome, coalesce(h.ret, 0) AS short_ret, CAST(coalesce(greatest(h.bars_held + p.entry_off + 1, 1), 5) AS INTEGER) AS short_bars,
         coalesce(h.outcome, 'none') AS short_outcome, p.later / p.close - 1 AS future_return,
         coalesce(l.ret * l.entry_px / (l.entry_px - l.stop), 0) AS long_r, coalesce(h.ret * h.entry_px / (h.stop - h.entry_px), 0) AS short_r
  FROM (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY i) AS later FROM planned) p JOIN scores s ON s.symbol = p.symbol AND s.i = p.i
  LEFT JOIN exits_long l ON l.symbol = p.symbol AND l.i = p.i LEFT JOIN exits_short h ON h.symbol = p.symbol AND h.i = p.i
  WHERE p.i >= 250 AND p.later IS NOT NULL"""
PARTS["signals"] = """
  SELECT symbol, side, i, ts, entry_off, score, ret, bars, r, outcome, threshold FROM (
    SELECT symbol, 'bull' AS side, i, ts, entry_off, bull_score AS score, long_ret AS ret, long_bars AS bars, long_r AS r, long_outcome AS outcome FROM wf
    UNION ALL SELECT symbol, 'bear', i, ts, entry_off, bear_score, short_ret, short_bars, short_r, short_outcome FROM wf),
    (VALUES (-1), (20), (25), (30), (35), (40), (45), (50)) t(threshold) WHERE score >= threshold"""
#: The next free signal of each signal, then the chain from each group's first.
PARTS["next_free"] = """
  SELECT a.*, row_number() OVER (PARTITION BY a.symbol, a.side, a.threshold ORDER BY a.i) AS n, b.i AS next_i FROM signals a
  ASOF LEFT JOIN signals b ON a.symbol = b.symbol AND a.side = b.side AND a.threshold = b.threshold AND a.i + a.bars <= b.i"""
PARTS["taken"] = """
  SELECT symbol, side, threshold, i, bars, next_i FROM next_free WHERE n = 1
  UNION ALL SELECT f.symbol, f.side, f.threshold, f.i, f.bars, f.next_i FROM taken t JOIN next_free f
    ON f.symbol = t.symbol AND f.side = t.side AND f.threshold = t.threshold AND f.i = t.next_i"""
PARTS["trades"] = "SELECT s.* FROM signals s SEMI JOIN taken t ON s.symbol = t.symbol AND s.side = t.side AND s.threshold = t.threshold AND s.i = t.i"
_Z = 2.5758


def _wilson(z: float, p: str, n: str) -> str:
    z2 = repr(z * z) + "::DOUBLE"
    return f"greatest(({p} + {z2} / (2 * {n}) - {z}::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n}))) / (1 + {z2} / {n}), 0)"


_COST = "0.00023::DOUBLE"
PARTS["sweep"] = f"""
  SELECT s.*, {_wilson(_Z, 'win_rate', 'n')} AS win_rate_lb, CASE WHEN n > 1 THEN lb END AS expectancy_lb FROM (
    SELECT symbol, side, threshold, count(*) AS n, count(*) FILTER (net > 0) AS wins, avg(CAST(net > 0 AS INTEGER)) AS win_rate, avg(net) AS expectancy,
           coalesce(avg(net) FILTER (net > 0), 0) AS avg_win, coalesce(avg(net) FILTER (net <= 0), 0) AS avg_loss, coalesce(sum(net) FILTER (net > 0), 0) AS gain,
           abs(coalesce(sum(net) FILTER (net <= 0), 0)) AS loss, avg(bars) AS avg_bars_held, avg(r) AS avg_r
    FROM (SELECT *, ret - {_COST} AS net FROM trades) GROUP BY symbol, side, threshold) s
  JOIN (SELECT symbol, side, threshold, CASE WHEN threshold < 0 THEN quantile_cont(m, 0.05) ELSE quantile_cont(m, {1 - 0.95 ** (1 / 7)!r}) END AS lb FROM resampled GROUP BY symbol, side, threshold) q
    ON q.symbol = s.symbol AND q.side = s.side AND q.threshold = s.threshold"""
#: 2,000 resamples of each group; the mean over what a resample counts, and how often.
PARTS["resampled"] = f"""
  SELECT symbol, side, threshold, b, sum(w * net) / nullif(sum(w), 0) AS m FROM (
    SELECT symbol, side, threshold, b, net, {" + ".join(f"(d >= {c})::INTEGER" for c in resample.poisson_steps())} AS w FROM (
      SELECT *, ((x * x + b) % {resample.PRIME}) % {resample.DRAWS} AS d FROM (
        SELECT *, (y * y + i) % {resample.PRIME} AS x FROM (
          SELECT symbol, side, threshold, CAST(i AS BIGINT) AS i, ret - {_COST} AS net, b, (i::BIGINT * {resample.ROW} + b * {resample.RESAMPLE} + {resample.OFFSET}) % {resample.PRIME} AS y
          FROM trades, range(2000) t(b))))) GROUP BY ALL"""
PARTS["picks"] = """
  SELECT symbol, side, coalesce(ok.excess, best.excess) AS excess_expectancy, coalesce(ok.threshold, best.threshold, 50) AS threshold, CASE WHEN ok IS NOT NULL THEN 'ok' WHEN best IS NOT NULL THEN 'no_edge' ELSE 'insufficient_data' END AS confidence,
         coalesce(ok.n, best.n, 0) AS n, coalesce(ok.expectancy, best.expectancy) AS expectancy, coalesce(ok.lb, best.lb) AS expectancy_lb
  FROM (SELECT symbol, side, arg_min(s, threshold) FILTER (n >= 30 AND expectancy_lb > 0) AS ok, arg_max(s, expectancy_lb) FILTER (n >= 30 AND expectancy_lb IS NOT NULL) AS best
    FROM (SELECT s.*, {'threshold': s.threshold, 'n': s.n, 'expectancy': s.expectancy, 'lb': s.expectancy_lb, 'excess': s.expectancy - b.expectancy} AS s
      FROM sweep s LEFT JOIN (SELECT * FROM sweep WHERE threshold = -1) b ON s.symbol = b.symbol AND s.side = b.side WHERE s.threshold >= 0) GROUP BY symbol, side)"""
PARTS["event_bars"] = """
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, CAST(row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) - 1 AS INTEGER) AS i,
        first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM events GROUP BY event_type, date_trunc('hour', ts)"""
PARTS["week_bars"] = """
  SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, close FROM (
    SELECT symbol, date_trunc('week', ts) AS ts, arg_max(close, bars.ts) AS close FROM bars GROUP BY symbol, date_trunc('week', ts))"""
PARTS["week_rets"] = "SELECT symbol, ts, i, close / lag(close) OVER (PARTITION BY symbol ORDER BY i) - 1 AS ret FROM week_bars QUALIFY ret IS NOT NULL"
PARTS["rets"] = "SELECT symbol, ts, i, close / lag(close) OVER (PARTITION BY symbol ORDER BY i) - 1 AS ret FROM bars QUALIFY ret IS NOT NULL"
PARTS["pairs"] = """
  SELECT a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS rho FROM common a JOIN common b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY ALL"""
PARTS["common"] = """
  SELECT * FROM lately WHERE ts IN (SELECT ts FROM lately GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM lately))"""
PARTS["lately"] = """
  SELECT symbol, ts, ret FROM week_rets QUALIFY count(*) OVER (PARTITION BY symbol) >= 30 AND row_number() OVER (PARTITION BY symbol ORDER BY i DESC) <= 252"""
PARTS["barriers"] = """
  SELECT symbol, i, CASE WHEN js IS NOT NULL AND (jw IS NULL OR js <= jw) THEN 'stop' WHEN jw IS NOT NULL THEN 'target' ELSE 'timeout' END AS outcome FROM (
    SELECT e.symbol, e.i, min(CASE WHEN b.low <= e.close - 1.5::DOUBLE * e.atr THEN b.i END) AS js, min(CASE WHEN b.high >= e.close + 2 * (1.5::DOUBLE * e.atr) THEN b.i END) AS jw
    FROM (SELECT *, max(i) OVER (PARTITION BY symbol) AS n FROM ind) e JOIN bars b ON b.symbol = e.symbol AND b.i BETWEEN e.i + 1 AND e.i + 20
    WHERE e.i >= 250 AND e.i < e.n - 21 AND e.atr > 0 GROUP BY e.symbol, e.i)"""
PARTS["barrier_stats"] = """
  SELECT symbol, count(*) FILTER (outcome = 'target') AS wins, count(*) FILTER (outcome <> 'timeout') AS n, avg(CAST(outcome = 'timeout' AS INTEGER)) AS timeout_rate FROM barriers GROUP BY symbol"""
PARTS["positions"] = """
  SELECT b.symbol, strftime(b.ts, '%Y-%m-%d') AS entry_date, b.close AS entry_price, CASE WHEN ends_with(b.symbol, '3') THEN b.close * 0.9::DOUBLE END AS stop
  FROM bars b JOIN (SELECT symbol, max(i) AS n FROM bars GROUP BY symbol) l ON l.symbol = b.symbol WHERE b.i = l.n - 60"""

PARTS["tracked"] = """
  SELECT *, CASE WHEN atr > 0 THEN greatest(f, peak - 5 * atr) ELSE f END AS s FROM (SELECT *, coalesce(stop, entry_price - 5 * atr) AS f FROM (
    SELECT p.symbol, p.entry_price, p.stop, max(b.high) AS peak, arg_max(b.close, b.ts) AS last, arg_max(b.atr, b.ts) AS atr, count(*) AS n_bars
    FROM positions p JOIN ind b ON b.symbol = p.symbol AND b.ts >= CAST(p.entry_date AS TIMESTAMP) GROUP BY p.symbol, p.entry_price, p.stop))"""
PARTS["net"] = f"SELECT *, ret - {_COST} AS net FROM trades WHERE threshold = 30"
PARTS["curve"] = """
  SELECT symbol, side, row_number() OVER w AS step, product(1 + net) OVER w AS equity FROM net WINDOW w AS (PARTITION BY symbol, side ORDER BY i)
  UNION ALL SELECT DISTINCT symbol, side, 0, 1 FROM net"""
PARTS["held"] = """
  SELECT symbol, count(*) AS n, arg_max(close, i) / arg_min(close, i) - 1 AS total, max(d) AS down FROM (
    SELECT *, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY i) AS d FROM bars WHERE i >= 250) GROUP BY symbol"""
PARTS["summary"] = """
  SELECT *, CASE WHEN bh_return IS NOT NULL AND max_drawdown > 0 THEN cagr / max_drawdown END AS calmar, CASE WHEN bh_drawdown > 0 THEN bh_cagr / bh_drawdown END AS bh_calmar FROM (
    SELECT c.symbol, c.side, n_trades, y AS years, n_trades / y AS trades_per_year, c.total AS total_return, pow(1 + c.total, 1 / y) - 1 AS cagr, max_drawdown, hold / n_bars AS time_in_market,
           h.total AS bh_return, pow(1 + h.total, 1 / y) - 1 AS bh_cagr, h.down AS bh_drawdown, c.total > h.total AS beats_bh, c.total - h.total AS excess_vs_bh
    FROM (SELECT symbol, side, count(*) - 1 AS n_trades, arg_max(equity, step) - 1 AS total, max(d) AS max_drawdown
          FROM (SELECT *, 1 - equity / max(equity) OVER (PARTITION BY symbol, side ORDER BY step) AS d FROM curve) GROUP BY symbol, side) c
    JOIN (SELECT symbol, side, sum(bars) AS hold FROM net GROUP BY symbol, side) t ON t.symbol = c.symbol AND t.side = c.side
    JOIN (SELECT symbol, count(*) AS n_bars, count(*) / 252::DOUBLE AS y FROM wf GROUP BY symbol) e ON e.symbol = c.symbol
    LEFT JOIN held h ON h.symbol = c.symbol AND c.side = 'bull')"""
PARTS["trail_path"] = """
  SELECT s.symbol, s.i, s.entry_px, s.long_stop AS stop, s.atr, b.i - s.i - s.entry_off - 1 AS j, b.low, b.close, greatest(s.entry_px, max(b.high) OVER w) AS best
  FROM planned s JOIN bars b ON b.symbol = s.symbol AND b.i BETWEEN s.i + s.entry_off + 2 AND s.i + s.entry_off + 251 WHERE s.long_stop IS NOT NULL
  WINDOW w AS (PARTITION BY s.symbol, s.i ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
for _name, _line in (("trailed", "greatest(stop, best - 3 * atr)"), ("trailed_even", "CASE WHEN best - entry_px >= entry_px - stop THEN greatest(stop, best - 3 * atr, entry_px) ELSE greatest(stop, best - 3 * atr) END")):
    PARTS[_name] = f"""
      SELECT symbol, i, CASE WHEN js IS NULL THEN 'timeout' ELSE 'stop' END AS outcome, coalesce(js, je) AS bars_held, (coalesce(px, ce) - entry_px) / entry_px AS ret FROM (
        SELECT symbol, i, entry_px, min(j) FILTER (low <= line) AS js, arg_min(line, j) FILTER (low <= line) AS px, max(j) AS je, arg_max(close, j) AS ce
        FROM (SELECT *, CASE WHEN j = 1 THEN stop ELSE {_line} END AS line FROM trail_path) GROUP BY symbol, i, entry_px)"""
PARTS["long_trades"] = """
  SELECT n.symbol, n.i AS trade, n.i + n.entry_off + 1 AS entry_i, n.i + n.bars AS exit_i, w.entry_px, n.ret, n.outcome, w.long_ret / nullif(w.long_r, 0) AS risk_share
  FROM net n JOIN wf w ON w.symbol = n.symbol AND w.i = n.i WHERE n.side = 'bull' AND n.bars > n.entry_off + 1"""
PARTS["excursions"] = """
  SELECT symbol, trade, entry_i, exit_i, any_value(ma) AS mae, any_value(mf) AS mfe, max(a) FILTER (j <= 3) AS entry_heat, min(j) FILTER (a = ma) AS bars_to_mae, min(j) FILTER (f = mf) AS bars_to_mfe
  FROM (SELECT *, max(a) OVER w AS ma, max(f) OVER w AS mf FROM (
      SELECT t.*, b.i - t.entry_i AS j, greatest((entry_px - low) / entry_px, 0) AS a, greatest((high - entry_px) / entry_px, 0) AS f
      FROM long_trades t JOIN bars b ON b.symbol = t.symbol AND b.i > t.entry_i AND b.i <= t.exit_i) WINDOW w AS (PARTITION BY symbol, trade)) GROUP BY symbol, trade, entry_i, exit_i"""
#: An entry at every evaluated bar.
PARTS["chance"] = """
  SELECT avg(CAST(heat > 0.01 AS INTEGER)) AS baseline_underwater FROM (
    SELECT w.symbol, w.i, max(greatest((w.entry_px - b.low) / w.entry_px, 0)) AS heat FROM wf w
    JOIN bars b ON b.symbol = w.symbol AND b.i > w.i + w.entry_off + 1 AND b.i <= least(w.i + w.entry_off + 4, w.i + w.long_bars) GROUP BY ALL)"""
PARTS["reviewed"] = """
  SELECT count(*) AS n_trades, avg(CAST(ret > 0 AS INTEGER)) AS win_rate, avg(ret) AS avg_ret, avg(CAST(outcome = 'stop' AS INTEGER)) AS share_stop, avg(CAST(outcome = 'target' AS INTEGER)) AS share_target,
         avg(CAST(outcome = 'timeout' AS INTEGER)) AS share_timeout, quantile_cont(mae, 0.5) FILTER (ret > 0) AS winner_mae_median, quantile_cont(mae, 0.9) FILTER (ret > 0) AS winner_mae_p90,
         quantile_cont(mae / nullif(risk_share, 0), 0.5) FILTER (ret > 0) AS winner_mae_r_median, quantile_cont(mfe, 0.5) FILTER (ret <= 0) AS loser_mfe_median,
         avg(CAST(mfe > 0.01 AS INTEGER)) FILTER (ret <= 0) AS loser_ever_profitable, sum(ret) / nullif(sum(mfe), 0) AS mfe_capture, quantile_cont(ret / nullif(mfe, 0), 0.5) AS mfe_capture_median_ratio,
         quantile_cont(mfe, 0.5) AS median_mfe, quantile_cont(ret, 0.5) AS median_realized, quantile_cont(entry_heat, 0.5) AS entry_heat_median, avg(CAST(entry_heat > 0.01 AS INTEGER)) AS immediately_underwater
  FROM (SELECT t.ret, t.outcome, t.risk_share, x.* FROM long_trades t JOIN excursions x ON x.symbol = t.symbol AND x.trade = t.trade)"""
#: The same plans for an entry at the signal's close.
PARTS["at_close"] = "SELECT *, close AS entry_px, -1 AS entry_off FROM ind"
PARTS["planned_close"] = PARTS["planned"].replace("FROM filled f", "FROM at_close f")
PARTS["exits_close"] = PARTS["exits_long"].replace("FROM planned s", "FROM planned_close s")
_COMPONENTS = ("zone", "order_block", "fvg", "choch", "bos", "sweep", "rsi", "macd", "ema_stack", "adx_di")
PARTS["matrix"] = f"""
  SELECT c.symbol, c.i, CAST(1 AS DOUBLE) AS one, {", ".join(f"CAST(bull_{n} AS DOUBLE) AS c_{n}" for n in _COMPONENTS)}, e.ret
  FROM components c JOIN exits_close e ON e.symbol = c.symbol AND e.i = c.i JOIN (SELECT symbol, max(i) AS n FROM bars GROUP BY symbol) l ON l.symbol = c.symbol
  WHERE c.i >= 250 AND c.i <= l.n - 5"""
#: The default weights' score on the component rows, the first 60 % to choose a threshold by, the last ones (20 rows on) to try it.
_MANUAL = " + ".join(f"{WEIGHTS[n]} * bull_{n}" for n in _COMPONENTS)
PARTS["trial"] = f"""
  SELECT *, CAST(row_number() OVER (PARTITION BY symbol, part ORDER BY i) - 1 AS INTEGER) AS pos FROM (
    SELECT *, CASE WHEN k < floor(n * 0.6::DOUBLE) THEN 'train' WHEN k < floor(n * 0.6::DOUBLE) + 20 THEN 'skipped' ELSE 'test' END AS part FROM (
      SELECT c.symbol, c.i, e.ret - {_COST} AS ret, greatest(e.bars_held, 1) AS bars, {_MANUAL} AS score,
             row_number() OVER (PARTITION BY c.symbol ORDER BY c.i) - 1 AS k, count(*) OVER (PARTITION BY c.symbol) AS n
      FROM components c JOIN exits_close e ON e.symbol = c.symbol AND e.i = c.i JOIN (SELECT symbol, max(i) AS n FROM bars GROUP BY symbol) l ON l.symbol = c.symbol
      WHERE c.i >= 250 AND c.i <= l.n - 5))"""
PARTS["trial_signals"] = "SELECT symbol, part, threshold, pos, bars, ret FROM trial, (VALUES (20), (25), (30), (35), (40), (45), (50)) t(threshold) WHERE score >= threshold AND part <> 'skipped'"
PARTS["trial_next"] = """
  SELECT a.*, row_number() OVER (PARTITION BY a.symbol, a.part, a.threshold ORDER BY a.pos) AS n, b.pos AS next_pos FROM trial_signals a
  ASOF LEFT JOIN trial_signals b ON a.symbol = b.symbol AND a.part = b.part AND a.threshold = b.threshold AND a.pos + a.bars <= b.pos"""
PARTS["trial_taken"] = """
  SELECT symbol, part, threshold, pos, ret, next_pos FROM trial_next WHERE n = 1
  UNION ALL SELECT f.symbol, f.part, f.threshold, f.pos, f.ret, f.next_pos FROM trial_taken t JOIN trial_next f
    ON f.symbol = t.symbol AND f.part = t.part AND f.threshold = t.threshold AND f.pos = t.next_pos"""
_GRAM = ["one", *(f"c_{n}" for n in _COMPONENTS), "ret"]


def _reasons(side: str) -> str:
    return f"concat_ws(',', {', '.join(f"CASE WHEN {side}_{n} > 0 THEN '{n}' END" for n in _COMPONENTS)}) AS {side}_reasons"


_REVIEW = ("win_rate", "avg_ret", "share_stop", "share_target", "share_timeout", "winner_mae_median", "winner_mae_p90", "winner_mae_r_median", "loser_mfe_median", "loser_ever_profitable", "mfe_capture", "mfe_capture_median_ratio", "median_mfe", "median_realized", "entry_heat_median", "immediately_underwater")
_FINDINGS = """CASE WHEN winner_mae_r_median < 0.35 THEN 'stop_can_tighten' WHEN winner_mae_r_median > 0.7 THEN 'stop_too_tight' END,
    CASE WHEN mfe_capture < 0.35 THEN 'exit_gives_back' WHEN mfe_capture > 0.6 THEN 'exit_efficient' END, CASE WHEN loser_ever_profitable > 0.5 THEN 'exit_too_late' END,
    CASE WHEN immediately_underwater - baseline_underwater > 0.08 THEN 'entry_chases' WHEN immediately_underwater - baseline_underwater < -0.08 THEN 'entry_better_than_random' WHEN immediately_underwater IS NOT NULL THEN 'entry_like_random' END, CASE WHEN share_timeout > 0.6 THEN 'target_too_far' END, CASE WHEN share_stop > 0.45 THEN 'stopped_often' END"""

#: The queries proper.
FINAL: dict[str, str] = {
    "bars_daily": "SELECT * FROM bars",
    "bars_hourly": "SELECT * FROM event_bars",
    "bars_resample": "SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, date_trunc('month', ts)",
    "calendar_union": "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar FROM (SELECT DISTINCT ts FROM bars)",
    "returns_daily": "SELECT symbol, ts, i, round(ret, 9) AS ret FROM rets",
    "horizon_return": "SELECT symbol, i, round(lead(close, 5) OVER (PARTITION BY symbol ORDER BY i) / close - 1, 9) AS future_return FROM bars",
    "ema20": "SELECT symbol, i, round(ema20 / close, 6) AS ema20_rel FROM ind",
    "rsi14": "SELECT symbol, i, round(rsi, 4) AS rsi FROM ind",
    "macd": "SELECT symbol, i, round(macd_line / close, 5) AS macd_line_rel, round(macd_signal / close, 5) AS macd_signal_rel, round(macd_hist / close, 5) AS macd_hist_rel FROM ind",
    "atr14": "SELECT i.symbol, i.i, round(m.tr / i.close, 6) AS tr_rel, round(atr / i.close, 6) AS atr_rel FROM ind i JOIN moves m ON m.symbol = i.symbol AND m.i = i.i",
    "adx14": "SELECT symbol, i, round(adx, 4) AS adx, round(plus_di, 4) AS plus_di, round(minus_di, 4) AS minus_di FROM ind",
    "obv": "SELECT symbol, i, sum(CASE WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) OVER (PARTITION BY symbol ORDER BY i) AS obv FROM moves",
    "indicator_set": "SELECT symbol, i, round(macd_hist / close, 5) AS macd_hist_rel, round(ema20 / close, 5) AS ema20_rel, round(ema50 / close, 5) AS ema50_rel, round(ema200 / close, 5) AS ema200_rel, round(atr / close, 5) AS atr_rel, round(rsi, 4) AS rsi, round(adx, 4) AS adx, round(plus_di, 4) AS plus_di, round(minus_di, 4) AS minus_di FROM ind",
    "confluence": """SELECT symbol, i, CAST(rsi > 50 AS INTEGER) + CAST(macd_hist > 0 AS INTEGER) + CAST(ema20 > ema50 AND ema50 > ema200 AS INTEGER) + CAST(adx >= 20 AND plus_di > minus_di AS INTEGER) AS n_bull,
        CAST(rsi < 50 AS INTEGER) + CAST(macd_hist < 0 AS INTEGER) + CAST(ema20 < ema50 AND ema50 < ema200 AS INTEGER) + CAST(adx >= 20 AND plus_di <= minus_di AS INTEGER) AS n_bear FROM ind""",
    "rolling_z": "SELECT symbol, i, CASE WHEN count(*) OVER w = 20 THEN round((volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0), 6) END AS z FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "dist_to_discount": "SELECT symbol, i, CASE WHEN count(*) OVER w = 50 THEN round((close - (max(high) OVER w + min(low) OVER w) / 2) / nullif(max(high) OVER w - min(low) OVER w, 0), 6) END AS dist_to_discount FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)",
    "swings_raw": "SELECT symbol, i, kind, price, conf_i FROM raw_swings",
    "swing_labels": "SELECT symbol, i, kind, price, conf_i, label FROM swings",
    "current_trend": "SELECT b.symbol, b.i, e.side AS trend FROM bars b ASOF LEFT JOIN breaks e ON e.symbol = b.symbol AND e.i <= b.i",
    "structure_events": "SELECT symbol, i, price, type, side, broken_level, broken_i FROM breaks",
    "structure_sql": "SELECT symbol, i, price, type, side, broken_level, broken_i FROM breaks",
    "structure_counts": "SELECT symbol, side, type, count(*) AS n FROM breaks GROUP BY ALL",
    "order_blocks": "SELECT * FROM obs",
    "price_gaps": """SELECT g.symbol, g.start_i, g.end_i, g.side, g.top, g.bottom, min(b.i) AS filled_i FROM (SELECT * FROM gaps0 WHERE (top - bottom) / ref >= 0.5) g
        LEFT JOIN bars b ON b.symbol = g.symbol AND b.i > g.end_i AND CASE WHEN g.side = 'bullish' THEN b.low <= g.top ELSE b.high >= g.bottom END GROUP BY g.symbol, g.start_i, g.end_i, g.side, g.top, g.bottom""",
    "price_gaps_atr": "SELECT * FROM gaps",
    "liquidity_pools": "SELECT * FROM pools",
    "zone_asof": "SELECT * FROM zones",
    "active_obs_asof": "SELECT b.symbol, b.i, count(*) FILTER (side = 'bullish') AS n_bull, count(*) FILTER (side = 'bearish') AS n_bear FROM bars b JOIN obs o ON o.symbol = b.symbol AND o.event_i <= b.i AND coalesce(o.mitigated_i, 1000000000) > b.i GROUP BY ALL",
    "active_gaps_asof": "SELECT b.symbol, b.i, count(*) FILTER (side = 'bullish') AS n_bull, count(*) FILTER (side = 'bearish') AS n_bear FROM bars b JOIN gaps o ON o.symbol = b.symbol AND o.end_i <= b.i AND coalesce(o.filled_i, 1000000000) > b.i GROUP BY ALL",
    "score_components": "SELECT * FROM components",
    "scores": "SELECT * FROM scores",
    "entry_plan": "SELECT symbol, i, round(limit_price / close, 6) AS limit_rel FROM filled",
    "entry_fill": "SELECT symbol, i, round(entry_px / close, 6) AS entry_rel, entry_off FROM filled",
    "trade_plan": "SELECT symbol, i, round(long_stop / entry_px, 5) AS long_stop, round(long_target / entry_px, 5) AS long_target, round(short_stop / entry_px, 5) AS short_stop, round(short_target / entry_px, 5) AS short_target FROM planned",
    "exit_fixed": "SELECT symbol, i, outcome, CAST(bars_held AS INTEGER) AS bars_held, round(ret, 6) AS ret FROM exits_long",
    "exit_fixed_short": "SELECT symbol, i, outcome, CAST(bars_held AS INTEGER) AS bars_held, round(ret, 6) AS ret FROM exits_short",
    "first_stop": "SELECT symbol, i, round(CASE WHEN atr > 0 THEN greatest(long_stop, limit_price - 5 * atr) ELSE long_stop END / close, 5) AS first_stop_rel FROM planned",
    "wf": "SELECT symbol, i, bull_score, bear_score, round(long_ret, 6) AS long_ret, long_bars, long_outcome, round(short_ret, 6) AS short_ret, short_bars, short_outcome, round(future_return, 6) AS future_return FROM wf",
    "non_overlap": "SELECT symbol, side, threshold, i, bars FROM taken",
    "non_overlap_fold": "SELECT symbol, side, i FROM taken WHERE threshold = 30",
    "threshold_sweep": """SELECT s.symbol, s.side, s.threshold, s.n, s.wins, round(s.win_rate, 6) AS win_rate, round(s.win_rate_lb, 6) AS win_rate_lb, round(s.expectancy, 6) AS expectancy, round(s.avg_win, 6) AS avg_win, round(s.avg_loss, 6) AS avg_loss,
        round(s.avg_bars_held, 6) AS avg_bars_held, round(s.avg_r, 6) AS avg_r, round(s.expectancy_lb, 6) AS expectancy_lb, round(s.expectancy - b.expectancy, 6) AS excess_expectancy,
        round(abs(s.avg_win / nullif(s.avg_loss, 0)), 6) AS payoff, round(s.gain / nullif(s.loss, 0), 6) AS profit_factor
        FROM sweep s LEFT JOIN (SELECT * FROM sweep WHERE threshold = -1) b ON s.symbol = b.symbol AND s.side = b.side WHERE s.threshold >= 0""",
    "sweep_totals": f"""SELECT symbol, side, threshold, CAST(grouping(symbol, side, threshold) AS INTEGER) AS level, count(*) AS n, count(*) FILTER (net > 0) AS wins, round(avg(CAST(net > 0 AS INTEGER)), 6) AS win_rate,
        round(avg(net), 6) AS expectancy, round(stddev_samp(net), 6) AS deviation FROM (SELECT *, ret - {_COST} AS net FROM trades WHERE threshold >= 0)
        GROUP BY GROUPING SETS ((symbol, side, threshold), (side, threshold), (threshold), (symbol, side), ())""",
    "base_rate": f"""SELECT symbol, side, n, wins, round(win_rate, 5) AS win_rate, round({_wilson(1.6449, 'win_rate', 'n')}, 5) AS win_rate_lb, round(expectancy, 5) AS expectancy, round(expectancy_lb, 5) AS expectancy_lb, round(avg_win, 5) AS avg_win, round(avg_loss, 5) AS avg_loss,
        round(abs(avg_win / nullif(avg_loss, 0)), 5) AS payoff, round(gain / nullif(loss, 0), 5) AS profit_factor
        FROM sweep WHERE threshold = -1""",
    "bootstrap_bounds": """SELECT symbol, side, threshold, n, round(lb, 6) AS mean_lb FROM (SELECT symbol, side, threshold, count(*) AS n FROM trades WHERE threshold IN (-1, 30, 40) GROUP BY ALL)
        JOIN (SELECT symbol, side, threshold, CASE WHEN count(*) > 0 THEN quantile_cont(m, 0.05) END AS lb FROM resampled GROUP BY ALL) USING (symbol, side, threshold)""",
    "cached_choice": "SELECT symbol, side, threshold, confidence, CASE WHEN ends_with(symbol, '1') THEN 'cached' ELSE 'computed' END AS source FROM picks",
    "recommend": "SELECT symbol, side, threshold, confidence, n, round(expectancy, 6) AS expectancy, round(expectancy_lb, 6) AS expectancy_lb, round(excess_expectancy, 6) AS excess_expectancy FROM picks",
    "selected_trades": f"""SELECT t.symbol, t.side, t.i, t.threshold, t.score, least(t.i + t.entry_off + 1, l.n) AS entry_i, least(t.i + t.bars, l.n) AS exit_i, round(t.ret - {_COST}, 6) AS ret, t.bars, t.outcome
        FROM trades t JOIN picks p ON p.symbol = t.symbol AND p.side = t.side AND p.threshold = t.threshold JOIN (SELECT symbol, max(i) AS n FROM wf GROUP BY symbol) l ON l.symbol = t.symbol WHERE t.side = 'bull'""",
    "cross_section": """SELECT side, count(*) AS n_evaluated, count(*) FILTER (confidence = 'ok') AS n_proven, round(avg(CAST(confidence = 'ok' AS INTEGER)), 6) AS share_proven, round(quantile_cont(expectancy, 0.5), 6) AS median_expectancy,
        round(avg(expectancy), 6) AS mean_expectancy, round(avg(CAST(expectancy > 0 AS INTEGER)), 6) AS share_positive, round(quantile_cont(excess_expectancy, 0.5), 6) AS median_excess,
        coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (confidence = 'ok'), '') AS proven FROM picks WHERE expectancy IS NOT NULL GROUP BY side""",
    "equity_curve": "SELECT symbol, side, step, round(sign(equity) * ln(1 + abs(equity)), 6) AS log_equity FROM curve",
    "performance_summary": """SELECT symbol, side, n_trades, round(years, 2) AS years, round(trades_per_year, 5) AS trades_per_year, round(sign(total_return) * ln(1 + abs(total_return)), 5) AS total_return, round(sign(cagr) * ln(1 + abs(cagr)), 5) AS cagr, round(max_drawdown, 5) AS max_drawdown,
        round(time_in_market, 5) AS time_in_market, round(bh_return, 5) AS bh_return, round(bh_cagr, 5) AS bh_cagr, round(bh_drawdown, 5) AS bh_drawdown, beats_bh, round(sign(excess_vs_bh) * ln(1 + abs(excess_vs_bh)), 5) AS excess_vs_bh,
        round(sign(calmar) * ln(1 + abs(calmar)), 5) AS calmar, round(bh_calmar, 5) AS bh_calmar, calmar > bh_calmar AS beats_bh_by_calmar FROM summary""",
    "exit_trailing": "SELECT symbol, i, outcome, CAST(bars_held AS INTEGER) AS bars_held, round(ret, 6) AS ret FROM trailed",
    "exit_breakeven": "SELECT symbol, i, outcome, CAST(bars_held AS INTEGER) AS bars_held, round(ret, 6) AS ret FROM trailed_even",
    "score_reasons": f"SELECT symbol, i, {_reasons('bull')}, {_reasons('bear')} FROM components",
    "trade_excursions": "SELECT symbol, trade, entry_i, exit_i, round(mae, 6) AS mae, round(mfe, 6) AS mfe, round(entry_heat, 6) AS entry_heat, bars_to_mae, bars_to_mfe FROM excursions",
    "review_summary": f"SELECT n_trades, {', '.join(f'round({c}, 5) AS {c}' for c in _REVIEW)}, round(baseline_underwater, 5) AS baseline_underwater, concat_ws(',', {_FINDINGS}) AS findings FROM reviewed JOIN chance ON true",
    "ridge_gram": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a} * {b}), 4) AS value FROM matrix" for k, a in enumerate(_GRAM) for b in _GRAM[k:]),
    "entry_ticket": """SELECT symbol, i, CASE WHEN abs(s - long_stop) < 1e-9 THEN 'plan' ELSE '5 x ATR' END AS stop_source, round((limit_price - s) / limit_price, 5) AS risk_share
        FROM (SELECT *, CASE WHEN atr > 0 THEN greatest(long_stop, limit_price - 5 * atr) ELSE long_stop END AS s FROM planned WHERE limit_price IS NOT NULL AND long_stop IS NOT NULL)""",
    "orders_today": """SELECT s.symbol, s.bull_score AS score, p.threshold, p.confidence, t.stop_source, round(t.risk, 5) AS risk_share
        FROM scores s JOIN (SELECT symbol, max(i) AS n FROM bars GROUP BY symbol) l ON l.symbol = s.symbol AND l.n = s.i JOIN picks p ON p.symbol = s.symbol AND p.side = 'bull' AND s.bull_score >= p.threshold
        LEFT JOIN (SELECT symbol, i, CASE WHEN abs(s - long_stop) < 1e-9 THEN 'plan' ELSE '5 x ATR' END AS stop_source, (limit_price - s) / limit_price AS risk
          FROM (SELECT *, CASE WHEN atr > 0 THEN greatest(long_stop, limit_price - 5 * atr) ELSE long_stop END AS s FROM planned WHERE limit_price IS NOT NULL AND long_stop IS NOT NULL)) t ON t.symbol = s.symbol AND t.i = s.i""",
    "chart_panels": """SELECT symbol, i, panel, series, CASE WHEN panel = 'rsi' THEN (round(value, 4) + 0) ELSE value END AS value FROM (
          SELECT symbol, i, 'price' AS panel, 'high' AS series, high AS value FROM ind UNION ALL SELECT symbol, i, 'price', 'close', close FROM ind UNION ALL SELECT symbol, i, 'rsi', 'rsi', rsi FROM ind
          UNION ALL SELECT symbol, i, 'zone', 'top', top FROM zones UNION ALL SELECT symbol, i, 'zone', 'mid', mid FROM zones) x
        JOIN (SELECT symbol AS s, max(i) AS n FROM bars GROUP BY symbol) l ON l.s = x.symbol WHERE i > n - 180""",
    "chart_layers": """SELECT s.symbol, layer, a AS from_i, coalesce(b, n) AS to_i, bottom, top, side FROM (
          SELECT symbol, 'order_block' AS layer, start_i AS a, NULL AS b, bottom, top, side FROM obs WHERE mitigated_i IS NULL
          UNION ALL SELECT symbol, 'gap', start_i, NULL, bottom, top, side FROM gaps WHERE filled_i IS NULL
          UNION ALL SELECT symbol, lower(type), broken_i, i, broken_level, broken_level, side FROM breaks) s
        JOIN (SELECT symbol, max(i) AS n FROM bars GROUP BY symbol) l ON l.symbol = s.symbol WHERE a > n - 180""",
    "buy_hold": """SELECT b.symbol, count(*) AS n, round(arg_max(close, i) / arg_min(close, i) - 1, 6) AS total_return, round(max(d), 6) AS max_drawdown, round(pow(arg_max(close, i) / arg_min(close, i), 252 / CAST(count(*) AS DOUBLE)) - 1, 6) AS cagr
        FROM (SELECT *, 1 - close / max(close) OVER (PARTITION BY symbol ORDER BY i) AS d FROM bars WHERE i >= 250) b GROUP BY b.symbol""",
    "equal_weight_bh": """SELECT bar, ts, round(avg(x), 6) AS curve FROM (
        SELECT c.bar, c.ts, last_value(b.close IGNORE NULLS) OVER (PARTITION BY f.symbol ORDER BY c.bar) / f.c0 AS x
        FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar FROM (SELECT DISTINCT ts FROM bars)) c CROSS JOIN (SELECT symbol, arg_min(close, ts) AS c0 FROM bars GROUP BY symbol) f
        LEFT JOIN bars b ON b.symbol = f.symbol AND b.ts = c.ts) GROUP BY bar, ts""",
    "corr_pairs": "SELECT a, b, round(rho, 6) AS rho FROM pairs",
    "n_eff": "SELECT n AS n_symbols, round(mean_rho, 6) AS mean_rho, round(n * n / (n + 2 * s), 6) AS n_eff, round(n / (n * n / (n + 2 * s)), 6) AS ratio FROM (SELECT (SELECT count(DISTINCT symbol) FROM week_bars) AS n, sum(rho) AS s, avg(rho) AS mean_rho FROM pairs)",
    "high_corr_pairs": "SELECT a, b, round(rho, 6) AS rho FROM pairs WHERE pairs.rho >= 0.1",
    "top_corr_pairs": "SELECT a, b, r AS rho FROM (SELECT a, b, round(rho, 6) + 0 AS r FROM pairs) WHERE r >= 0.1 ORDER BY r DESC, a, b LIMIT 5",
    "signal_concentration": """WITH on_ AS (SELECT symbol FROM scores GROUP BY symbol HAVING arg_max(bull_score, i) >= 15),
        r AS (SELECT (SELECT count(*) FROM on_) AS n, coalesce(sum(rho), 0) AS s, avg(rho) AS mean_rho FROM pairs WHERE a IN (SELECT symbol FROM on_) AND b IN (SELECT symbol FROM on_)),
        e AS (SELECT *, CASE WHEN n < 2 THEN CAST(n AS DOUBLE) WHEN n + 2 * s > 0 THEN n * n / (n + 2 * s) END AS eff FROM r)
        SELECT n AS n_measured, round(mean_rho, 6) AS mean_rho, round(eff, 6) AS n_eff, round(CASE WHEN n >= 2 THEN n / eff END, 6) AS ratio, n + 1 AS n_signals,
          CASE WHEN n >= 2 AND eff IS NOT NULL THEN CASE WHEN n / eff >= 2.5 THEN 'high' WHEN n / eff >= 1.6 THEN 'medium' ELSE 'low' END END AS band FROM e""",
    "cost_model": """SELECT symbol, etf, round(CASE WHEN regexp_matches(symbol, '\\.TWO?$') THEN 0.001425::DOUBLE * 0.6::DOUBLE * 2 + CASE WHEN etf THEN 0.001::DOUBLE ELSE 0.003::DOUBLE END ELSE 0.00023::DOUBLE END, 9) AS cost
        FROM (SELECT DISTINCT p_brand || CASE WHEN ends_with(p_brand, '1') THEN '.TW' WHEN ends_with(p_brand, '2') THEN '.TWO' ELSE '' END AS symbol, ends_with(p_brand, '11') AS etf FROM part)""",
    "exit_policy_lookup": """SELECT c_custkey, budget, coalesce((SELECT arg_max(w, b) FROM (VALUES (0.20, 1.0::DOUBLE), (0.25, 1.0), (0.30, 2.0), (0.35, 2.5), (0.40, 5.0), (0.45, 5.0), (0.50, 5.0), (0.60, 5.0)) t(b, w) WHERE b <= budget + 1e-9), 1.0::DOUBLE) AS trail_atr_mult
        FROM (SELECT c_custkey, (c_custkey % 70 + 10) / 100::DOUBLE AS budget FROM customer)""",
    "exit_policy_terms": """SELECT c_custkey, budget, t.b AS matched_budget, t.w AS trail_atr_mult, t.g AS expected_cagr, t.dd AS expected_drawdown, t.od AS oos_drawdown, t.x AS oos_breach, t.w <= 1.0 AS floor_reached
        FROM (SELECT c_custkey, (c_custkey % 70 + 10) / 100::DOUBLE AS budget FROM customer) c JOIN (VALUES (0.20::DOUBLE, 1.0::DOUBLE, 0.035::DOUBLE, -0.180::DOUBLE, -0.311::DOUBLE, '18/22'), (0.25, 1.0, 0.035, -0.180, -0.340, '18/22'),
          (0.30, 2.0, 0.049, -0.277, -0.340, '15/22'), (0.35, 2.5, 0.083, -0.329, -0.340, '10/22'), (0.40, 5.0, 0.153, -0.387, -0.340, '9/22'), (0.45, 5.0, 0.153, -0.387, -0.340, '5/22'),
          (0.50, 5.0, 0.153, -0.387, -0.340, '4/22'), (0.60, 5.0, 0.153, -0.387, -0.340, '0/22')) t(b, w, g, dd, od, x)
        ON t.b = CASE WHEN budget < 0.25 - 1e-9 THEN 0.20 WHEN budget < 0.30 - 1e-9 THEN 0.25 WHEN budget < 0.35 - 1e-9 THEN 0.30 WHEN budget < 0.40 - 1e-9 THEN 0.35 WHEN budget < 0.45 - 1e-9 THEN 0.40
          WHEN budget < 0.50 - 1e-9 THEN 0.45 WHEN budget < 0.60 - 1e-9 THEN 0.50 ELSE 0.60 END""",
    "wilson": f"SELECT o_custkey, n, wins, round({_wilson(1.96, '(wins / n)', 'n')}, 9) AS lower FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS wins FROM orders GROUP BY o_custkey)",
    "barrier_exhaustive": "SELECT symbol, wins, n, round(timeout_rate, 6) AS timeout_rate FROM barrier_stats",
    "barrier_random": """WITH risks AS (SELECT symbol, risk, row_number() OVER (PARTITION BY symbol ORDER BY risk) - 1 AS place FROM (SELECT symbol, ret / nullif(r, 0) AS risk FROM trades WHERE side = 'bull' AND threshold = 30) WHERE risk > 0),
        drawn AS (SELECT s.symbol, d, 250 + CAST('0x' || substr(md5(s.symbol || ':42:' || d), 1, 8) AS BIGINT) % (n + 1 - 250 - 2 - 250) AS i, CAST('0x' || substr(md5(s.symbol || ':42:' || d), 9, 8) AS BIGINT) % m AS place
          FROM (SELECT symbol, max(i) AS n FROM bars GROUP BY symbol) s JOIN (SELECT symbol, count(*) AS m FROM risks GROUP BY symbol) k ON k.symbol = s.symbol, range(600) t(d) WHERE n + 1 - 250 - 2 > 250),
        entries AS (SELECT e.symbol, e.d, e.i, b.close * (1 - r.risk) AS stop, b.close * (1 + 2 * r.risk) AS target FROM drawn e JOIN risks r ON r.symbol = e.symbol AND r.place = e.place JOIN bars b ON b.symbol = e.symbol AND b.i = e.i WHERE b.close > 0),
        ends AS (SELECT e.symbol, e.d, min(CASE WHEN b.low <= e.stop THEN b.i END) AS js, min(CASE WHEN b.high >= e.target THEN b.i END) AS jw FROM entries e JOIN bars b ON b.symbol = e.symbol AND b.i BETWEEN e.i + 1 AND e.i + 250 GROUP BY ALL)
        SELECT symbol, count(*) FILTER (jw IS NOT NULL AND (js IS NULL OR js > jw)) AS wins, count(*) FILTER (coalesce(js, jw) IS NOT NULL) AS n, round(avg(CAST(coalesce(js, jw) IS NULL AS INTEGER)), 6) AS timeout_rate FROM ends GROUP BY symbol""",
    "kelly_sizing": f"""SELECT symbol, wins, n, round(timeout_rate, 6) AS timeout_rate, round(p, 6) AS p_lower, round(CASE WHEN n >= 100 THEN k END, 6) AS kelly_full,
        round(CASE WHEN n < 100 OR p <= 1 / 3::DOUBLE OR p IS NULL THEN 0 ELSE least(k / 4, 0.2::DOUBLE) END, 6) AS fraction,
        CASE WHEN n < 100 THEN 'few_samples' WHEN p <= 1 / 3::DOUBLE THEN 'below_break_even' WHEN k / 4 > 0.2 THEN 'capped' ELSE 'kelly' END AS reason
        FROM (SELECT *, greatest((p * 2 - (1 - p)) / 2, 0) AS k FROM (SELECT *, CASE WHEN n > 0 THEN {_wilson(1.96, '(wins / n)', 'n')} END AS p FROM barrier_stats))""",
    "positions_track": """SELECT symbol, n_bars, s >= entry_price AS locked_in, last <= s AS breached, round(peak / entry_price, 5) AS peak_rel, round(last / entry_price, 5) AS last_rel, round(f / entry_price, 5) AS initial_stop_rel,
        round(s / entry_price, 5) AS stop_rel, round(last / entry_price - 1, 6) AS unrealized, round(CASE WHEN entry_price > f THEN (last - entry_price) / (entry_price - f) END, 4) AS unrealized_r,
        round(CASE WHEN last > 0 THEN (last - s) / last END, 5) AS stop_distance FROM tracked""",
    "position_kpis": """SELECT count(*) AS n_positions, count(*) FILTER (s >= entry_price) AS n_locked_in, count(*) FILTER (last <= s) AS n_breached, round(avg(last / entry_price - 1), 5) AS mean_unrealized,
        round(avg(CASE WHEN entry_price > f THEN (last - entry_price) / (entry_price - f) END), 5) AS mean_unrealized_r, round(min((last - s) / last), 5) AS nearest_stop FROM tracked""",
    "positions_untracked": "SELECT min(symbol) || '-gone' AS symbol FROM positions",
    "mtm_lookup": """SELECT p.symbol, round(p.entry_price, 6) AS entry_price, round(l.c, 6) AS mark, true AS priced FROM positions p JOIN (SELECT symbol, arg_max(close, i) AS c FROM bars GROUP BY symbol) l ON l.symbol = p.symbol
        UNION ALL SELECT symbol || '-gone', round(entry_price, 6), round(entry_price, 6), false FROM (SELECT * FROM positions ORDER BY symbol LIMIT 1)""",
    "alert_dedup": """WITH g AS (SELECT 'C' || o_custkey AS symbol, o_orderstatus AS side, max({'ts': o_orderdate, 'k': o_orderkey, 'score': CAST(floor(o_totalprice / 1000) AS DOUBLE)}) AS a,
          min({'ts': o_orderdate, 'k': o_orderkey, 'score': CAST(floor(o_totalprice / 1000) AS DOUBLE)}) AS s FROM orders GROUP BY ALL)
        SELECT symbol, side, a.score AS score FROM g WHERE NOT (right(symbol, 1) IN ('1', '2') AND epoch(TIMESTAMP '1995-06-17' - s.ts) / 86400 < 600 AND abs(a.score - s.score) < 40)""",
    "ml_features": """SELECT symbol, i, round(rsi, 4) AS rsi, round(macd_hist, 2) AS macd_hist, round(adx, 4) AS adx, round(plus_di - minus_di, 4) AS di_diff, round((close - ema20) / close, 4) AS ema20_gap, round((close - ema50) / close, 4) AS ema50_gap,
        CAST(CASE WHEN ema20 > ema50 THEN 1 ELSE -1 END + CASE WHEN ema50 > ema200 THEN 1 ELSE -1 END AS DOUBLE) AS trend_align, round(atr / close, 4) AS atr_pct,
        CASE WHEN count(*) OVER v = 20 THEN round((volume - avg(volume) OVER v) / nullif(stddev_samp(volume) OVER v, 0), 4) END AS volume_z,
        CASE WHEN count(*) OVER w = 50 THEN round((close - (max(high) OVER w + min(low) OVER w) / 2) / nullif(max(high) OVER w - min(low) OVER w, 0), 4) END AS dist_to_discount
        FROM ind WINDOW v AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    "ml_labels": "SELECT symbol, i, CAST(coalesce(lead(close, 5) OVER (PARTITION BY symbol ORDER BY i) / close - 1 > 0, false) AS INTEGER) AS label FROM bars",
    "rsi_auc": """SELECT symbol, fold, n, round(auc, 6) AS auc FROM (
        SELECT symbol, fold, count(*) AS n, (sum(CASE WHEN label = 1 THEN rank END) - sum(label) * (sum(label) + 1) / 2::DOUBLE) / nullif(sum(label) * (count(*) - sum(label)), 0)::DOUBLE AS auc FROM (
          SELECT *, rank() OVER (PARTITION BY symbol, fold ORDER BY score) + (count(*) OVER (PARTITION BY symbol, fold, score) - 1) / 2::DOUBLE AS rank FROM (
            SELECT symbol, round(rsi, 4) AS score, CAST(coalesce(later / close - 1 > 0, false) AS INTEGER) AS label, CASE WHEN k >= n - 5 * (n // 6) THEN CAST((k - (n - 5 * (n // 6))) // (n // 6) + 1 AS INTEGER) ELSE 0 END AS fold
            FROM (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY i) AS later, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM ind))) GROUP BY ALL)""",
    "weight_trial_manual": """WITH able AS (SELECT symbol, avg(ret) FILTER (part = 'test') AS base FROM trial GROUP BY symbol HAVING count(*) >= 400 AND count(*) FILTER (part = 'train') >= 200 AND count(*) FILTER (part = 'test') >= 200),
        stats AS (SELECT symbol, part, threshold, count(*) AS n, avg(ret) AS expectancy FROM trial_taken GROUP BY ALL),
        best AS (SELECT symbol, arg_max(threshold, {'e': expectancy, 'low': -threshold}) AS threshold FROM stats WHERE part = 'train' AND n >= 15 GROUP BY symbol)
        SELECT s.symbol, 'manual' AS kind, s.threshold, s.n, round(s.expectancy, 6) AS expectancy, round(s.expectancy - a.base, 6) AS excess
        FROM stats s JOIN best b ON b.symbol = s.symbol AND b.threshold = s.threshold JOIN able a ON a.symbol = s.symbol WHERE s.part = 'test' AND s.n >= 8""",
    "embargo_split": """SELECT symbol, part, count(*) AS n, min(i) AS first_i, max(i) AS last_i FROM (SELECT symbol, i, CASE WHEN k < cut THEN 'train' WHEN k < cut + 20 THEN 'skipped' ELSE 'test' END AS part FROM (
        SELECT symbol, i, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS k, floor(count(*) OVER (PARTITION BY symbol) * 0.6::DOUBLE) AS cut FROM bars WHERE i >= 250)) GROUP BY ALL""",
}


def _assemble(final: str) -> str:
    """WITH clause of all parts that a query needs, each after those it uses."""
    placed: dict[str, str] = {}

    def need(text: str, inside: str = "") -> None:
        for name in PARTS:
            if name != inside and name not in placed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(PARTS[name], name)
                placed.setdefault(name, PARTS[name])

    # Without a sign on zero, as in the catalogue.
    final = re.sub(r"round\((.+?), (\d+)\) AS", r"(round(\1, \2) + 0) AS", final, flags=re.S)
    need(final)
    if not placed:
        return final
    lead = ",\n".join(f"{n} AS ({t})" for n, t in placed.items())
    if final.startswith("WITH "):
        return f"WITH RECURSIVE {lead},\n{final[5:]}"
    return f"WITH RECURSIVE {lead}\n{final}"


SQL: dict[str, str] = {name: _assemble(text) for name, text in FINAL.items()}
