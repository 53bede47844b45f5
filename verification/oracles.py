"""Independent SQL for the registered queries, written for a single-node engine.

Common steps are named table expressions; `_q` puts the ones a statement needs in front.
"""

from __future__ import annotations

import re

CTE: dict[str, tuple[list[str], str]] = {}


def _cte(name: str, needs: list[str], sql: str) -> None:
    CTE[name] = (needs, sql)


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in CTE[n][0]:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def _q(needs: list[str], sql: str) -> str:
    parts = [f"{n} AS MATERIALIZED ({CTE[n][1]})" if not n.startswith("ewm") else f"{n} AS ({CTE[n][1]})" for n in _closure(needs)]
    return f"WITH RECURSIVE {', '.join(parts)} {sql}" if parts else sql


# Short decimals by construction: rounded late enough that no value sits on a tie.
SHORT_DECIMALS = {"Open", "High", "Low", "Close", "Volume", "SMA_10", "SMA_50", "SMA_200", "Volume_SMA_20", "OBV_norm", "MOM_5",
                  "body_size", "upper_shadow", "lower_shadow", "p10", "p50", "p90"}


SIX_DIGITS = {"BB_upper", "BB_lower"}


def digits_of(column: str, default: int) -> int:
    return 8 if column in SHORT_DECIMALS else 6 if column in SIX_DIGITS else default


def mean_digits(column: str) -> int:
    """Means of whole volumes can be short decimals themselves, with a 5 as their last digit."""
    return 8 if column == "Volume_SMA_20" else 4


def _r(cols: list[str], digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits_of(c.strip(chr(34)), digits)}) AS {c}" for c in cols)


TICKER = "'S' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0')"
DENSE = """SELECT k.ticker, CAST(d.d AS DATE) AS date FROM (SELECT DISTINCT ticker FROM {day}) k,
    (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM (SELECT min(date) AS lo, max(date) AS hi FROM {day})) d
    WHERE isodow(d.d) < 6"""
WALK = """SELECT ticker, date, coalesce(lag(c) OVER w, c) AS "Open", c AS "Close", v FROM (
      SELECT ticker, date, v, round(100 * exp(sum(shock) OVER (PARTITION BY ticker ORDER BY date)), 4) AS c FROM (
        SELECT g.ticker, g.date, coalesce(d.v, 0) AS v,
          coalesce(CAST(0.02 AS DOUBLE) * (d.c / avg(d.c) OVER (PARTITION BY g.ticker) - 1), 0) AS shock
        FROM {grid} g LEFT JOIN {day} d ON g.ticker = d.ticker AND g.date = d.date))
    WINDOW w AS (PARTITION BY ticker ORDER BY date)"""

_cte("day", [], f"""SELECT {TICKER} AS ticker, CAST(l_shipdate AS DATE) - CAST(greatest(isodow(l_shipdate) - 5, 0) AS INTEGER) AS date, avg(l_extendedprice) AS c, sum(l_quantity) AS v
    FROM lineitem GROUP BY 1, 2""")
_cte("grid", ["day"], DENSE.format(day="day"))
_cte("walk", ["day", "grid"], WALK.format(grid="grid", day="day"))
_cte("bars", ["walk"], """SELECT ticker, date, "Open",
      greatest("Open", "Close") * (CAST(1 AS DOUBLE) + (1 + v % 7) * CAST(0.001 AS DOUBLE)) AS "High",
      least("Open", "Close") * (CAST(1 AS DOUBLE) - (1 + v % 5) * CAST(0.001 AS DOUBLE)) AS "Low",
      "Close", v AS "Volume" FROM walk""")
_cte("iday", [], """SELECT 'INDEX' AS ticker, CAST(l_shipdate AS DATE) - CAST(greatest(isodow(l_shipdate) - 5, 0) AS INTEGER) AS date, avg(l_extendedprice) AS c, sum(l_quantity) AS v
    FROM lineitem GROUP BY 1, 2""")
_cte("igrid", ["iday"], DENSE.format(day="iday"))
_cte("iwalk", ["iday", "igrid"], WALK.format(grid="igrid", day="iday"))
_cte("vix", ["iwalk"], """SELECT date, vix FROM (
      SELECT date, CASE WHEN count(r) OVER f = 21 THEN stddev_samp(r) OVER f * 100 END AS vix
      FROM (SELECT date, "Close" / lag("Close") OVER (ORDER BY date) - 1 AS r FROM iwalk)
      WINDOW f AS (ORDER BY date ROWS 20 PRECEDING)) WHERE day(date) NOT IN (13, 27)""")
_cte("market", ["iwalk", "vix"], """SELECT i.date, last_value(v.vix IGNORE NULLS) OVER (ORDER BY i.date ROWS UNBOUNDED PRECEDING) AS vix_close,
      "Close" / lag("Close", 21) OVER (ORDER BY i.date) - 1 AS sp500_ret_21d,
      "Close" / lag("Close", 63) OVER (ORDER BY i.date) - 1 AS sp500_ret_63d
    FROM iwalk i LEFT JOIN vix v ON i.date = v.date""")
_cte("joined", ["bars", "market"], """SELECT b.*,
      last_value(m.vix_close IGNORE NULLS) OVER w AS vix_close,
      last_value(m.sp500_ret_21d IGNORE NULLS) OVER w AS sp500_ret_21d,
      last_value(m.sp500_ret_63d IGNORE NULLS) OVER w AS sp500_ret_63d
    FROM bars b LEFT JOIN market m ON b.date = m.date
    WINDOW w AS (PARTITION BY b.ticker ORDER BY b.date ROWS UNBOUNDED PRECEDING)""")
_cte("step", ["joined"], """SELECT *, "Close" - pc AS dc, greatest("High" - "Low", abs("High" - pc), abs("Low" - pc)) AS tr,
      "Close" - "Open" AS body, CASE WHEN "High" - "Low" = 0 THEN 1e-9 ELSE "High" - "Low" END AS full_,
      sum(coalesce(sign("Close" - pc), 0) * "Volume") OVER (PARTITION BY ticker ORDER BY date) AS obv
    FROM (SELECT *, lag("Close") OVER w AS pc, lag("Open") OVER w AS po, row_number() OVER w AS rn,
      "Close" - lag("Close", 5) OVER w AS "MOM_5", "Close" / lag("Close", 21) OVER w - 1 AS "ROC_21"
      FROM joined WINDOW w AS (PARTITION BY ticker ORDER BY date))""")


def _frame(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"


def _roll(fn: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {_frame(n)} = {n} THEN {fn}({c}) OVER {_frame(n)} END"


_cte("rolled", ["step"], f"""SELECT *,
    {_roll('avg', '"Close"', 10)} AS "SMA_10", {_roll('avg', '"Close"', 50)} AS "SMA_50", {_roll('avg', '"Close"', 200)} AS "SMA_200",
    {_roll('avg', '"Close"', 20)} AS s20, {_roll('stddev_samp', '"Close"', 20)} AS d20,
    {_roll('sum', 'CASE WHEN dc > 0 THEN dc WHEN dc <= 0 THEN 0 END', 14)} / 14 AS gain,
    {_roll('sum', 'CASE WHEN dc < 0 THEN -dc WHEN dc >= 0 THEN 0 END', 14)} / 14 AS loss,
    {_roll('sum', 'CASE WHEN dc < 0 THEN 1 WHEN dc >= 0 THEN 0 END', 14)} AS n_loss,
    {_roll('max', '"High"', 14)} AS h14, {_roll('min', '"Low"', 14)} AS l14, {_roll('avg', 'tr', 14)} AS "ATR_14",
    {_roll('avg', '"Volume"', 20)} AS "Volume_SMA_20",
    {_roll('max', '"High"', 252)} AS h252, {_roll('min', '"Low"', 252)} AS l252, {_roll('max', 'obv', 252)} AS o252
    FROM step""")
_cte("feats", ["rolled"], """SELECT *, s20 + 2 * d20 AS "BB_upper", s20 - 2 * d20 AS "BB_lower",
    ((s20 + 2 * d20) - (s20 - 2 * d20)) / (s20 + 1e-9) AS "BB_width",
    CASE WHEN n_loss > 0 THEN 100 - 100 / (1 + gain / loss) END AS "RSI_14",
    -100 * (h14 - "Close") / (h14 - l14 + 1e-9) AS "Williams_R",
    obv / abs(CASE WHEN o252 = 0 THEN 1 ELSE o252 END) AS "OBV_norm",
    "Volume" / ("Volume_SMA_20" + 1e-9) AS "Volume_ratio",
    abs(body) AS body_size, "High" - greatest("Close", "Open") AS upper_shadow, least("Close", "Open") - "Low" AS lower_shadow,
    body / full_ AS body_pct, ("Close" - h252) / (h252 + 1e-9) AS pct_from_52w_high, ("Close" - l252) / (l252 + 1e-9) AS pct_from_52w_low,
    full_ / ("Close" + 1e-9) AS price_range_pct,
    lag("SMA_50") OVER (PARTITION BY ticker ORDER BY date) AS ps50 FROM rolled""")
_cte("allf", ["feats"], """SELECT *,
    CASE WHEN body_size < CAST(0.1 AS DOUBLE) * full_ THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS doji,
    CASE WHEN pc < ps50 AND body_size < CAST(0.3 AS DOUBLE) * full_ AND lower_shadow > 2 * body_size
      AND upper_shadow < CAST(0.1 AS DOUBLE) * full_ THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hammer,
    CASE WHEN pc > ps50 AND body_size < CAST(0.3 AS DOUBLE) * full_ AND upper_shadow > 2 * body_size
      AND lower_shadow < CAST(0.1 AS DOUBLE) * full_ THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS shooting_star,
    CASE WHEN body > 0 AND pc - po < 0 AND "Close" > po AND "Open" < pc THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS engulfing
    FROM feats""")
_cte("srow", ["bars"], """SELECT ticker, date, "Close" AS c, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM bars""")
_cte("ewm", ["srow"], """SELECT ticker, date, rn, c AS e12, c AS e26, CAST(0 AS DOUBLE) AS sig FROM srow WHERE rn = 1
    UNION ALL
    SELECT s.ticker, s.date, s.rn, e.e12 + (s.c - e.e12) * CAST(2 AS DOUBLE) / 13, e.e26 + (s.c - e.e26) * CAST(2 AS DOUBLE) / 27,
      e.sig + ((e.e12 + (s.c - e.e12) * CAST(2 AS DOUBLE) / 13) - (e.e26 + (s.c - e.e26) * CAST(2 AS DOUBLE) / 27) - e.sig) * CAST(2 AS DOUBLE) / 10
    FROM ewm e JOIN srow s ON s.ticker = e.ticker AND s.rn = e.rn + 1""")
_cte("macd", ["ewm"], """SELECT ticker, date, e12 - e26 AS "MACD", sig AS "MACD_signal" FROM ewm""")
# MACD and its signal are never null, so completeness does not depend on them.
_cte("done", ["allf"], """SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k, count(*) OVER (PARTITION BY ticker) AS nk
    FROM allf WHERE "RSI_14" IS NOT NULL AND h252 IS NOT NULL AND o252 IS NOT NULL AND "SMA_200" IS NOT NULL
      AND vix_close IS NOT NULL AND sp500_ret_21d IS NOT NULL AND sp500_ret_63d IS NOT NULL""")
_cte("panel", ["done"], """SELECT * EXCLUDE (date), date AS end_date, "Close" AS base_close FROM (
    SELECT *, lead("Close", 21) OVER w / "Close" - 1 AS y_1m, lead("Close", 63) OVER w / "Close" - 1 AS y_3m,
      lead("Close", 126) OVER w / "Close" - 1 AS y_6m, lead(date, 126) OVER w AS label_end
    FROM done WHERE nk >= 378 WINDOW w AS (PARTITION BY ticker ORDER BY date))
    WHERE k >= 252 AND label_end IS NOT NULL""")
_cte("anchors", ["panel"], """SELECT * FROM panel QUALIFY row_number() OVER (
    PARTITION BY ticker, date_trunc('month', end_date) ORDER BY end_date DESC) = 1""")


def _busday(d: str, n: int) -> str:
    base = f"({d} - CAST(greatest(isodow({d}) - 5, 0) AS INTEGER))"
    weeks, rest = divmod(n, 5)
    return f"CAST({base} + {7 * weeks + rest} + CASE WHEN isodow({base}) + {rest} > 5 THEN 2 ELSE 0 END AS DATE)"


_cte("blocks", ["panel"], f"""SELECT fold, block_start, {_busday('block_start', 126)} AS test_lo, block_end FROM (
    SELECT fold, min(end_date) AS block_start, max(end_date) AS block_end FROM (
      SELECT end_date, CAST(ntile(4) OVER (ORDER BY end_date) AS INTEGER) AS fold FROM (
        SELECT end_date, row_number() OVER (ORDER BY end_date) AS rn FROM (SELECT DISTINCT end_date FROM panel)) WHERE rn > 252)
    GROUP BY fold)""")
_cte("folds", ["blocks", "panel"], f"""SELECT * FROM blocks b WHERE
    EXISTS (SELECT 1 FROM panel p WHERE p.end_date BETWEEN b.test_lo AND b.block_end)
    AND EXISTS (SELECT 1 FROM panel p WHERE {_busday('p.end_date', 126)} < b.test_lo)""")
_cte("train", ["folds", "panel"], f"""SELECT fold, y_1m, y_3m, y_6m, ticker, end_date FROM panel p JOIN folds f ON {_busday('p.end_date', 126)} < f.test_lo""")
_cte("trainl", ["train"], """SELECT fold, '1m' AS horizon, y_1m AS y FROM train UNION ALL SELECT fold, '3m', y_3m FROM train
    UNION ALL SELECT fold, '6m', y_6m FROM train""")
_cte("scored", ["anchors", "folds"], """SELECT a.*, f.fold, CASE WHEN f.fold = (SELECT min(fold) FROM folds)
      AND (SELECT count(*) FROM folds) > 1 THEN 'val' ELSE 'test' END AS split
    FROM anchors a JOIN folds f ON a.end_date BETWEEN f.test_lo AND f.block_end""")
_cte("scoredl", ["scored"], """SELECT fold, split, ticker, end_date, '1m' AS horizon, CAST(21 AS DOUBLE) AS h, y_1m AS y FROM scored
    UNION ALL SELECT fold, split, ticker, end_date, '3m', 63, y_3m FROM scored UNION ALL SELECT fold, split, ticker, end_date, '6m', 126, y_6m FROM scored""")
Z = "CAST(1.2815515655446004 AS DOUBLE)"
_cte("rw", ["trainl"], f"""SELECT fold, horizon, -{Z} * stddev_samp(y) AS q10, CAST(0 AS DOUBLE) AS q50, {Z} * stddev_samp(y) AS q90 FROM trainl GROUP BY ALL""")
_cte("hq", ["trainl"], """SELECT fold, horizon, quantile_cont(y, 0.1) AS q10, quantile_cont(y, 0.5) AS q50, quantile_cont(y, 0.9) AS q90 FROM trainl GROUP BY ALL""")
_cte("vol", ["bars"], """SELECT ticker, date, lp, CASE WHEN count(r) OVER f = 252 THEN stddev_samp(r) OVER f END AS sigma FROM (
      SELECT ticker, date, ln("Close") AS lp, ln("Close") - lag(ln("Close")) OVER (PARTITION BY ticker ORDER BY date) AS r FROM bars)
    WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)""")
_cte("sv", ["scoredl", "vol"], f"""SELECT s.*, exp(-{Z} * sigma * sqrt(h)) - 1 AS q10, CAST(0 AS DOUBLE) AS q50, exp({Z} * sigma * sqrt(h)) - 1 AS q90
    FROM scoredl s JOIN vol v ON s.ticker = v.ticker AND s.end_date = v.date""")
_cte("pair", ["sv", "hq"], """SELECT s.fold, s.split, s.ticker, s.end_date, s.horizon, s.y, s.q10 AS a10, s.q50 AS a50, s.q90 AS a90,
    b.q10 AS b10, b.q50 AS b50, b.q90 AS b90 FROM sv s JOIN hq b ON s.fold = b.fold AND s.horizon = b.horizon""")


def _sorted3(a: str, b: str, c: str) -> tuple[str, str, str]:
    return (f"least({a}, {b}, {c})", f"greatest(least({a}, {b}), least(greatest({a}, {b}), {c}))", f"greatest({a}, {b}, {c})")


def _mix(w: str) -> str:
    q = _sorted3(*[f"({w} * a{p} + (1 - {w}) * b{p})" for p in (10, 50, 90)])
    return ", ".join(f"{e} AS q{p}" for e, p in zip(q, (10, 50, 90)))


PIN = """(greatest(CAST(0.1 AS DOUBLE) * (y - q10), CAST(-0.9 AS DOUBLE) * (y - q10)) + greatest(CAST(0.5 AS DOUBLE) * (y - q50), CAST(-0.5 AS DOUBLE) * (y - q50))
    + greatest(CAST(0.9 AS DOUBLE) * (y - q90), CAST(-0.1 AS DOUBLE) * (y - q90))) / 3"""
_cte("curve", ["pair"], f"""SELECT horizon, w, avg({PIN}) AS loss FROM (SELECT horizon, y, w, {_mix('w')} FROM pair,
    (SELECT CAST(i AS DOUBLE) / 20 AS w FROM range(21) t(i)) WHERE split = 'val') GROUP BY ALL""")
_cte("weight", ["curve"], """SELECT horizon, w FROM curve QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY loss, w) = 1""")
_cte("mixed", ["pair", "weight"], f"""SELECT p.* EXCLUDE (a10, a50, a90, b10, b50, b90), w, {_mix('w')} FROM pair p JOIN weight USING (horizon)""")
_cte("score", ["mixed"], """SELECT horizon, greatest(q10 - y, y - q90) AS s, row_number() OVER (PARTITION BY horizon ORDER BY greatest(q10 - y, y - q90)) - 1 AS i,
    count(*) OVER (PARTITION BY horizon) AS n FROM mixed WHERE split = 'val'""")
_cte("rankat", ["score"], """SELECT horizon, s, i, (n - 1) * least(1, ceil((n + 1) * CAST(0.8 AS DOUBLE)) / n) AS pos FROM score""")
_cte("delta", ["rankat"], """SELECT horizon, max(CASE WHEN i = floor(pos) THEN s END) + (max(CASE WHEN i = ceil(pos) THEN s END)
    - max(CASE WHEN i = floor(pos) THEN s END)) * max(pos - floor(pos)) AS delta FROM rankat GROUP BY horizon""")
_cte("params", ["weight", "delta"], "SELECT horizon, w, delta FROM weight JOIN delta USING (horizon)")
_E = _sorted3("q10 - delta", "q50", "q90 + delta")
_cte("ens", ["mixed", "delta"], f"""SELECT fold, split, ticker, end_date, horizon, y, {_E[0]} AS e10, {_E[1]} AS e50, {_E[2]} AS e90
    FROM mixed JOIN delta USING (horizon)""")
_cte("longp", ["scoredl", "rw", "hq", "sv", "ens"], """
    SELECT 'random_walk' AS model, s.split, s.horizon, s.y, q10, q50, q90 FROM scoredl s JOIN rw USING (fold, horizon)
    UNION ALL SELECT 'baseline', s.split, s.horizon, s.y, q10, q50, q90 FROM scoredl s JOIN hq USING (fold, horizon)
    UNION ALL SELECT 'series_vol', split, horizon, y, q10, q50, q90 FROM sv
    UNION ALL SELECT 'ensemble', split, horizon, y, e10, e50, e90 FROM ens""")
_cte("ranked", ["longp"], """SELECT *, rank() OVER (PARTITION BY model, horizon ORDER BY y) + (count(*) OVER (PARTITION BY model, horizon, y) - 1) / 2.0 AS ry,
    rank() OVER (PARTITION BY model, horizon ORDER BY q50) + (count(*) OVER (PARTITION BY model, horizon, q50) - 1) / 2.0 AS rp
    FROM longp WHERE split = 'test'""")
_cte("board", ["ranked"], f"""SELECT model, horizon, avg({PIN}) AS pinball,
    avg(CASE WHEN y >= q10 AND y <= q90 THEN 1.0 ELSE 0.0 END) AS coverage,
    avg(CASE WHEN (q50 >= 0) = (y >= 0) THEN 1.0 ELSE 0.0 END) AS hit_rate,
    CASE WHEN min(rp) < max(rp) AND min(ry) < max(ry) THEN covar_pop(ry, rp) / (stddev_pop(ry) * stddev_pop(rp)) END AS ic
    FROM ranked GROUP BY model, horizon""")
_cte("signal", ["scored"], """SELECT end_date, ticker, "ROC_21" AS pred, y_1m AS realized FROM scored""")
_cte("sel", ["signal"], """SELECT *, CAST(greatest(1, round_even(n * CAST(0.2 AS DOUBLE), 0)) AS INTEGER) AS k FROM (SELECT *,
      count(*) OVER (PARTITION BY end_date) AS n, row_number() OVER (PARTITION BY end_date ORDER BY pred, ticker) AS i FROM signal) WHERE n >= 5""")
_cte("seqd", ["sel"], "SELECT end_date, row_number() OVER (ORDER BY end_date) AS seq FROM (SELECT DISTINCT end_date FROM sel)")
_cte("longs", ["sel", "seqd"], "SELECT seq, ticker, end_date FROM sel JOIN seqd USING (end_date) WHERE i > n - k")
_cte("turn", ["longs"], """SELECT a.end_date, avg(CASE WHEN b.ticker IS NULL THEN 1.0 ELSE 0.0 END) AS turnover
    FROM longs a LEFT JOIN longs b ON a.ticker = b.ticker AND a.seq = b.seq + 1 GROUP BY a.end_date""")
_cte("monthly", ["sel", "turn"], """SELECT end_date, lo - sh AS long_short, lo AS long_only, b AS benchmark, turnover FROM (
    SELECT end_date, avg(realized) FILTER (WHERE i > n - k) AS lo, avg(realized) FILTER (WHERE i <= k) AS sh, avg(realized) AS b FROM sel GROUP BY end_date)
    JOIN turn USING (end_date)""")
_cte("books", ["monthly"], """SELECT end_date, 'long_short' AS book, long_short AS r, turnover FROM monthly UNION ALL
    SELECT end_date, 'long_only', long_only, turnover FROM monthly UNION ALL SELECT end_date, 'benchmark', benchmark, turnover FROM monthly""")
# The same book with the library's own settings: deciles of months with 30 names or more.
for _name in ("sel", "seqd", "longs", "turn", "monthly", "books"):
    _needs, _sql = CTE[_name]
    for _other in ("sel", "seqd", "longs", "turn", "monthly"):
        _sql = re.sub(rf"\b(FROM|JOIN) {_other}\b", rf"\1 {_other}_own", _sql)
    _cte(f"{_name}_own", [n if n == "signal" else f"{n}_own" for n in _needs], _sql.replace("CAST(0.2 AS DOUBLE)", "CAST(0.1 AS DOUBLE)").replace("n >= 5", "n >= 30"))
_EQ = """SELECT *, max(equity) OVER (PARTITION BY {k} ORDER BY end_date) AS peak FROM (
    SELECT *, product(1 + r) OVER (PARTITION BY {k} ORDER BY end_date) AS equity FROM {t})"""
_STAT = """round(avg(r) * 12, 4) AS ann_return, round(stddev_samp(r) * sqrt(12), 4) AS ann_vol,
    CASE WHEN stddev_samp(r) * sqrt(12) > 1e-12 THEN round(avg(r) * 12 / (stddev_samp(r) * sqrt(12)), 3) END AS sharpe,
    CASE WHEN arg_max(equity, end_date) > 0 THEN round(pow(arg_max(equity, end_date), CAST(12 AS DOUBLE) / count(*)) - 1, 4) END AS cagr,
    round(min(equity / peak - 1), 4) AS max_drawdown, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 3) AS hit_rate"""
_cte("eq", ["books"], _EQ.format(k="book", t="books"))
_cte("net", ["monthly"], """SELECT end_date, bps, long_short - turnover * 2 * (CAST(bps AS DOUBLE) / 10000) AS r FROM monthly,
    (SELECT unnest([0, 5, 10, 20, 30]) AS bps)""")
_cte("neteq", ["net"], _EQ.format(k="bps", t="net"))
_cte("costs", ["neteq"], f"SELECT bps, sharpe, cagr, ann_return FROM (SELECT bps, {_STAT} FROM neteq GROUP BY bps)")
_cte("track", ["signal"], """SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY end_date) - 1 AS INTEGER) AS i,
    round(pred, 4) AS pred, round(realized, 4) AS realized FROM signal QUALIFY count(*) OVER (PARTITION BY ticker) >= 12""")
_cte("raw", [], f"""SELECT ticker, date, "Open", "High", "Low", CASE WHEN "Volume" % 23 = 0 THEN NULL WHEN "Volume" % 29 = 0 THEN -c ELSE c END AS "Close", "Volume" FROM (
    SELECT {TICKER} AS ticker, CAST(l_shipdate AS DATE) AS date,
      first(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS "Open",
      max(l_extendedprice) AS "High", min(l_extendedprice) AS "Low",
      last(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS c, sum(l_quantity) AS "Volume"
    FROM lineitem GROUP BY 1, 2)""")
_cte("rawstat", ["raw"], """SELECT ticker, avg(CASE WHEN "Close" IS NULL THEN 1.0 ELSE 0.0 END) AS nulls, count(*) FILTER (WHERE "Close" > 0) AS usable FROM raw GROUP BY ticker""")
_cte("first_reason", ["rawstat"], """SELECT ticker, CASE WHEN nulls > CAST(0.05 AS DOUBLE) THEN 'too many missing closes'
    WHEN usable < 480 THEN usable || ' usable rows of 480' END AS reason FROM rawstat WHERE CAST(substr(ticker, 2, 7) AS INTEGER) % 5 <> 4""")
_cte("gated", ["raw", "rawstat"], """SELECT raw.* FROM raw JOIN rawstat USING (ticker) WHERE nulls <= CAST(0.05 AS DOUBLE) AND usable >= 480 AND "Close" > 0""")
_cte("move", ["gated"], """SELECT *, "Close" / lag("Close") OVER (PARTITION BY ticker ORDER BY date) - 1 AS r,
    first_value("Close") OVER (PARTITION BY ticker ORDER BY date) AS c0 FROM gated""")
_cte("fixed", ["move"], """SELECT *, CASE WHEN spiky THEN c0 * g ELSE "Close" END AS c FROM (SELECT *,
      coalesce(bool_or(abs(r) > 0.5) OVER (PARTITION BY ticker), false) AS spiky,
      product(CASE WHEN r IS NULL THEN 1 WHEN r > 0.5 THEN 1.5 WHEN r < -0.5 THEN 0.5 ELSE 1 + r END) OVER (PARTITION BY ticker ORDER BY date) AS g FROM move)""")
_cte("meta", [], """SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS ticker, s_name AS name, n_name AS sector
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 3""")
_cte("latest", ["done"], "SELECT *, date AS end_date FROM done WHERE nk >= 378 AND k = nk")
_cte("fc", ["latest", "vol", "meta"], f"""SELECT l.ticker, coalesce(m.name, l.ticker) AS name, coalesce(m.sector, 'Unknown') AS sector,
    strftime(l.date, '%Y-%m-%d') AS anchor_date, round(l."Close", 4) AS anchor_price, horizon,
    round(exp(-{Z} * sigma * sqrt(h)) - 1, 6) AS q10, CAST(0 AS DOUBLE) AS q50, round(exp({Z} * sigma * sqrt(h)) - 1, 6) AS q90
    FROM latest l JOIN vol v ON l.ticker = v.ticker AND l.date = v.date LEFT JOIN meta m ON l.ticker = m.ticker,
    (VALUES ('1m', CAST(21 AS DOUBLE)), ('3m', 63), ('6m', 126)) t(horizon, h)""")
_cte("hist", ["bars", "fc"], """SELECT ticker, date, round("Close", 4) AS close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn
    FROM bars WHERE ticker IN (SELECT ticker FROM fc) QUALIFY rn <= 180""")
_cte("fan", ["fc"], """SELECT ticker, CASE horizon WHEN '1m' THEN 21 WHEN '3m' THEN 63 ELSE 126 END AS day, anchor_price * (1 + q10) AS p10,
    anchor_price * (1 + q50) AS p50, anchor_price * (1 + q90) AS p90 FROM fc
    UNION ALL SELECT DISTINCT ticker, 0, anchor_price, anchor_price, anchor_price FROM fc""")
_cte("extent", ["hist", "fan"], """SELECT ticker, min(p) AS y_min, max(p) AS y_max FROM (SELECT ticker, close AS p FROM hist WHERE rn <= 120
    UNION ALL SELECT ticker, p10 FROM fan UNION ALL SELECT ticker, p90 FROM fan) GROUP BY ticker""")
_cte("skill", ["track"], """SELECT ticker, count(*) FILTER (WHERE (pred >= 0) = (realized >= 0)) AS hits, count(*) AS n,
    avg(CASE WHEN (pred >= 0) = (realized >= 0) THEN 1.0 ELSE 0.0 END) AS hr,
    CASE WHEN min(pred) < max(pred) AND min(realized) < max(realized) THEN covar_pop(pred, realized) / (stddev_pop(pred) * stddev_pop(realized)) ELSE 0 END AS cr
    FROM track GROUP BY ticker""")
_cte("ret", ["bars"], """SELECT ticker, date, r, r * r AS x, row_number() OVER (PARTITION BY ticker ORDER BY date) AS t FROM (
    SELECT ticker, date, "Close" / lag("Close") OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars) WHERE r IS NOT NULL""")
_cte("longrun", ["ret"], "SELECT ticker, avg(x) AS v, count(*) AS n FROM ret GROUP BY ticker")
_cte("ewmg", ["ret", "longrun"], """SELECT r.ticker, t, x, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, v, n, v AS s
    FROM ret r JOIN longrun USING (ticker), (SELECT unnest([0.03, 0.05, 0.10]) AS a), (SELECT unnest([0.80, 0.88, 0.94]) AS b) WHERE t = 1
    UNION ALL
    SELECT g.ticker, r.t, r.x, a, b, v, n, v * (1 - a - b) + a * g.x + b * g.s FROM ewmg g JOIN ret r ON r.ticker = g.ticker AND r.t = g.t + 1""")
_cte("fitg", ["ewmg"], """SELECT ticker, a, b, sum(ln(s) + x / s) AS loss, max(v) AS v,
    max(CASE WHEN t = n THEN v * (1 - a - b) + a * x + b * s END) AS nxt FROM ewmg GROUP BY ticker, a, b""")
_cte("ewmfit", ["ret", "longrun"], """SELECT r.ticker, t, x, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, v, v AS s
    FROM ret r JOIN longrun USING (ticker), (SELECT unnest([0.03, 0.05, 0.10, 0.18]) AS a),
      (SELECT unnest([0.70, 0.80, 0.85, 0.88, 0.91, 0.94, 0.965, 0.98]) AS b) WHERE t = 1 AND a + b <= 0.9995
    UNION ALL
    SELECT g.ticker, r.t, r.x, a, b, v, v * (1 - a - b) + a * g.x + b * g.s FROM ewmfit g JOIN ret r ON r.ticker = g.ticker AND r.t = g.t + 1""")
_cte("lret", ["bars"], """SELECT ticker, date, lp, r, row_number() OVER (PARTITION BY ticker ORDER BY date) AS t FROM (
    SELECT ticker, date, ln("Close") AS lp, ln("Close") - lag(ln("Close")) OVER (PARTITION BY ticker ORDER BY date) AS r FROM bars) WHERE r IS NOT NULL""")
_cte("ewmdrift", ["lret"], """SELECT ticker, date, lp, t, phi, beta, r AS e, beta * r AS b FROM lret, (VALUES (CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)),
      (0.8, -0.1), (0.8, 0.05), (0.8, 0.15), (0.9, -0.05), (0.9, 0.05), (0.9, 0.15), (0.97, 0.02), (0.97, 0.05)) g(phi, beta) WHERE t = 1
    UNION ALL
    SELECT r.ticker, r.date, r.lp, r.t, phi, beta, r.r - phi * d.b, phi * d.b + beta * (r.r - phi * d.b) FROM ewmdrift d JOIN lret r ON r.ticker = d.ticker AND r.t = d.t + 1""")
_cte("drifting", ["ewmdrift"], """SELECT ticker, date, lp, t, phi, beta, b, sum(e * e) OVER past AS loss, sqrt(sum(e * e) OVER last_year / 252) AS sigma FROM ewmdrift
    WINDOW past AS (PARTITION BY ticker, phi, beta ORDER BY t), last_year AS (PARTITION BY ticker, phi, beta ORDER BY t ROWS 251 PRECEDING)""")
_cte("drift", ["drifting"], """SELECT ticker, date, lp, t, phi, beta, b, CASE WHEN t >= 252 THEN sigma END AS sigma FROM (
      SELECT *, max(CASE WHEN phi = 0 THEN loss END) OVER (PARTITION BY ticker, t) AS still FROM drifting)
    WHERE phi = 0 OR loss * pow(t, CAST(2 AS DOUBLE) / t) < still
    QUALIFY row_number() OVER (PARTITION BY ticker, t ORDER BY phi = 0, loss, phi, beta) = 1""")
_DRIFT_SQL = """list_sum(list_transform(range(1, CAST({h} AS BIGINT) + 1), lambda k: pow(phi, k))) * b AS m,
    sigma * sqrt(list_sum(list_transform(range(0, CAST({h} AS BIGINT)), lambda j: pow(1 + beta * phi * (1 - pow(phi, j)) / (1 - phi), 2)))) AS s"""

FEATURE_COLS = """"Open" "High" "Low" "Close" "Volume" "SMA_10" "SMA_50" "SMA_200" "MACD" "MACD_signal" "RSI_14" "MOM_5" "ROC_21"
 "Williams_R" "ATR_14" "BB_upper" "BB_lower" "BB_width" "OBV_norm" "Volume_SMA_20" "Volume_ratio" body_size upper_shadow lower_shadow
 body_pct doji hammer shooting_star engulfing pct_from_52w_high pct_from_52w_low price_range_pct vix_close sp500_ret_21d sp500_ret_63d""".split()
LABELS = ["y_1m", "y_3m", "y_6m"]
QS = ["q10", "q50", "q90"]


def _feature_sql(cols: list[str]) -> str:
    if "MACD" in cols:
        return _q(["macd"], f"SELECT ticker, date, {_r(cols)} FROM macd")
    names = [f'"{c}"' for c in cols]
    return _q(["allf"], f"SELECT ticker, date, {_r(names)} FROM allf")


# Each ticker's features from a day of its own on.
CUT = "date >= CAST('1993-01-01' AS DATE) + CAST(CAST(substr(ticker, 2, 7) AS INTEGER) % 7 * 400 AS INTEGER)"


def oracles(feature_groups: dict[str, list[str]]) -> dict[str, str]:
    out = {
        "bars_daily": """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
            first(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS "Open", max(l_extendedprice) AS "High",
            min(l_extendedprice) AS "Low", last(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS "Close",
            round(sum(l_quantity), 4) AS "Volume" FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
        "bars_hourly_events": """SELECT event_type AS ticker, date_trunc('hour', ts) AS hour, first(value ORDER BY event_id) AS "Open",
            max(value) AS "High", min(value) AS "Low", last(value ORDER BY event_id) AS "Close", count(*) AS n FROM events GROUP BY 1, 2""",
        "symbol_normalise": "SELECT upper(replace(lower(p_brand) || '.' || p_size, '.', '-')) AS symbol, count(*) AS n FROM part GROUP BY 1",
        "bars_walk": _q(["bars"], f"""SELECT ticker, date, {_r(['"Open"', '"High"', '"Low"', '"Close"'])}, "Volume" FROM bars"""),
        "bars_cache_upsert": _q(["raw"], """SELECT ticker, date, CASE WHEN fresh THEN 2 * "Open" ELSE "Open" END AS "Open", "High", "Low", "Close",
            round("Volume", 8) AS "Volume" FROM (SELECT *, CAST(substr(ticker, 2, 7) AS INTEGER) % 3 = 0 AND date >= DATE '1995-07-01' AS fresh FROM raw)
            WHERE fresh OR date < DATE '1996-01-01'"""),
        "bars_cache_scan": _q(["raw"], """SELECT ticker, count(*) AS n, max(date) AS last FROM raw WHERE "Close" IS NOT NULL GROUP BY ticker"""),
        "market_series": _q(["market"], f"SELECT date, {_r(['vix_close', 'sp500_ret_21d', 'sp500_ret_63d'], 6)} FROM market"),
        "constituents_meta": _q(["meta"], "SELECT * FROM meta"),
        "metrics_params": _q(["params"], f"SELECT horizon, {_r(['w', 'delta'], 6)} FROM params"),
        "quality_gate": _q(["gated"], 'SELECT ticker, date, "Close" FROM gated'),
        "quality_rejects": _q(["rawstat"], """SELECT ticker, CASE WHEN nulls > CAST(0.05 AS DOUBLE) THEN 'too many missing closes'
            ELSE usable || ' usable rows of 480' END AS reason FROM rawstat WHERE nulls > CAST(0.05 AS DOUBLE) OR usable < 480
            UNION ALL SELECT ticker, 'no bars' FROM (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS ticker FROM supplier
            UNION ALL SELECT n_name FROM nation) WHERE ticker NOT IN (SELECT ticker FROM rawstat)"""),
        "quality_repair": _q(["fixed"], """SELECT ticker, date, "Open", round(ln(c), 4) AS ln_close,
            round(ln(CASE WHEN spiky THEN greatest("Open", "High", "Low", c) ELSE "High" END), 4) AS ln_high,
            round(ln(CASE WHEN spiky THEN least("Open", "High", "Low", c) ELSE "Low" END), 4) AS ln_low, "Volume" FROM fixed"""),
        "history_gate": _q(["done"], f"""SELECT ticker, count(*) || ' feature rows of 1026' AS reason FROM done WHERE {CUT} GROUP BY ticker HAVING count(*) < 1026"""),
        "quality_skip_report": _q(["first_reason", "done"], f"""SELECT * FROM first_reason WHERE reason IS NOT NULL
            UNION ALL SELECT ticker, 'no bars' FROM (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS ticker FROM supplier
            UNION ALL SELECT n_name FROM nation) WHERE ticker NOT IN (SELECT ticker FROM first_reason)
            UNION ALL SELECT ticker, coalesce(n, 0) || ' feature rows of 1026' FROM first_reason LEFT JOIN (SELECT ticker, count(*) AS n FROM done WHERE {CUT} GROUP BY ticker) USING (ticker)
            WHERE reason IS NULL AND coalesce(n, 0) < 1026"""),
        "market_cached": _q(["market"], f"SELECT date, {_r(['vix_close', 'sp500_ret_21d', 'sp500_ret_63d'], 6)} FROM market"),
        "bt_monthly_defaults": _q(["monthly_own"], f"SELECT end_date, {_r(['long_short', 'long_only', 'benchmark', 'turnover'], 6)} FROM monthly_own"),
        "bt_stats_defaults": _q(["books_own"], f"""SELECT book, {_STAT}, CASE WHEN book <> 'benchmark' THEN round(avg(turnover), 3) END AS avg_turnover
            FROM ({_EQ.format(k='book', t='books_own')}) GROUP BY book"""),
        "view_forecast_horizons": _q(["fc"], "SELECT '1m,3m,6m' AS anchor_horizons, '21,63,126' AS horizon_rows, count(DISTINCT ticker) AS n_forecasts FROM fc"),
        "market_join_ffill": _q(["joined"], f"SELECT ticker, date, {_r(['vix_close', 'sp500_ret_21d', 'sp500_ret_63d'], 6)} FROM joined"),
        "features_complete": _q(["done", "macd"], f"""SELECT ticker, count(*) AS n, min(date) AS first, max(date) AS last,
            {', '.join(f'round(avg({c}), {mean_digits(c.strip(chr(34)))}) AS {c}' for c in FEATURE_COLS)} FROM done JOIN macd USING (ticker, date) GROUP BY ticker"""),
        "windows_tensor": _q(["done"], """SELECT ticker, date AS end_date, 60 AS rows, 35 AS cols, round(CAST(CAST(c0 AS FLOAT) AS DOUBLE), 2) AS first_close,
            round(CAST(CAST("Close" AS FLOAT) AS DOUBLE), 2) AS last_close, round(CAST(CAST(a AS FLOAT) AS DOUBLE), 4) AS y_1w, round(CAST(CAST(b AS FLOAT) AS DOUBLE), 4) AS y_1m
            FROM (SELECT ticker, date, k, "Close", lag("Close", 59) OVER w AS c0, lead("Close", 5) OVER w / "Close" - 1 AS a, lead("Close", 21) OVER w / "Close" - 1 AS b
            FROM done WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE k >= 60 AND b IS NOT NULL"""),
        "windows_tensor_full": _q(["done"], """SELECT ticker, date AS end_date, 252 AS rows, 35 AS cols, round(CAST(CAST(c0 AS FLOAT) AS DOUBLE), 2) AS first_close,
            round(CAST(CAST("Close" AS FLOAT) AS DOUBLE), 2) AS last_close, round(total, 2) AS sum_close, round(CAST(CAST(a AS FLOAT) AS DOUBLE), 4) AS y_1m,
            round(CAST(CAST(b AS FLOAT) AS DOUBLE), 4) AS y_3m, round(CAST(CAST(c AS FLOAT) AS DOUBLE), 4) AS y_6m
            FROM (SELECT ticker, date, k, "Close", lag("Close", 251) OVER w AS c0, lead("Close", 21) OVER w / "Close" - 1 AS a, lead("Close", 63) OVER w / "Close" - 1 AS b,
            lead("Close", 126) OVER w / "Close" - 1 AS c, sum(CAST(CAST("Close" AS FLOAT) AS DOUBLE)) OVER (w ROWS 251 PRECEDING) AS total
            FROM done WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE k >= 252 AND c IS NOT NULL"""),
        "labels_forward": _q(["panel"], f"SELECT ticker, end_date, base_close, {_r(LABELS, 6)}, label_end FROM panel"),
        "panel": _q(["panel", "macd"], f"""SELECT p.ticker, end_date, {_r([*FEATURE_COLS, *LABELS, 'base_close'])}
            FROM panel p JOIN macd m ON p.ticker = m.ticker AND p.end_date = m.date"""),
        "panel_written": _q(["panel"], "SELECT ticker, count(*) AS n, round(sum(base_close), 3) AS base_close, max(end_date) AS last FROM panel GROUP BY ticker"),
        "month_anchors": _q(["anchors"], "SELECT ticker, end_date, base_close, round(y_1m, 6) AS y_1m FROM anchors"),
        "latest_features": _q(["latest"], """SELECT ticker, end_date, round("Close", 8) AS "Close", round("SMA_50", 8) AS "SMA_50",
            round("RSI_14", 4) AS "RSI_14", round("Close", 4) AS base_close FROM latest"""),
        "business_days": f"""SELECT d, {', '.join(f'{_busday("d", n)} AS plus_{n}' for n in (1, 3, 5, 126))}
            FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""",
        "cv_fold_bounds": _q(["blocks"], "SELECT * FROM blocks"),
        "cv_roles": _q(["train", "panel", "folds"], """SELECT fold, 'train' AS role, count(*) AS n, min(end_date) AS first, max(end_date) AS last, count(DISTINCT ticker) AS tickers
            FROM train GROUP BY fold UNION ALL SELECT fold, 'test', count(*), min(end_date), max(end_date), count(DISTINCT ticker)
            FROM panel p JOIN folds f ON p.end_date BETWEEN f.test_lo AND f.block_end GROUP BY fold"""),
        "cv_roles_rows_purge": _q(["blocks", "panel"], """SELECT fold, 'train' AS role, count(*) AS n, max(end_date) AS last FROM panel p JOIN blocks f ON p.label_end < f.test_lo
            GROUP BY fold UNION ALL SELECT fold, 'test', count(*), max(end_date) FROM panel p JOIN blocks f ON p.end_date BETWEEN f.test_lo AND f.block_end GROUP BY fold"""),
        "m_boosted_invariants": _q(["scoredl"], """SELECT fold, horizon, count(*) AS n, 0 AS nulls, 0 AS crossings, 0 AS outside
            FROM scoredl GROUP BY fold, horizon"""),
        "cv_scored_anchors": _q(["scored"], "SELECT ticker, end_date, fold, split FROM scored"),
        "m_random_walk": _q(["rw"], f"SELECT fold, horizon, {_r(QS, 6)} FROM rw"),
        "m_hist_quantile": _q(["hq"], f"SELECT fold, horizon, {_r(QS, 6)} FROM hq"),
        "m_series_vol": _q(["sv"], f"SELECT fold, ticker, end_date, horizon, {_r(QS, 6)} FROM sv"),
        "m_series_vol_asof": _q(["scoredl", "bars"], f"""SELECT fold, s.ticker, end_date, horizon, round(exp(-{Z} * sigma * sqrt(h)) - 1, 6) AS q10,
            CASE WHEN sigma IS NOT NULL THEN CAST(0 AS DOUBLE) END AS q50, round(exp({Z} * sigma * sqrt(h)) - 1, 6) AS q90
            FROM (SELECT * REPLACE (end_date + CAST(day(end_date) % 7 + 1 AS INTEGER) AS end_date) FROM scoredl) s
            ASOF LEFT JOIN (SELECT ticker, date, CASE WHEN count(r) OVER f = 252 THEN stddev_samp(r) OVER f END AS sigma FROM (
                SELECT ticker, date, ln("Close") - lag(ln("Close")) OVER (PARTITION BY ticker ORDER BY date) AS r FROM bars WHERE day(date) % 10 <> 3)
              WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)) v
            ON s.ticker = v.ticker AND s.end_date >= v.date"""),
        "m_series_paths": _q(["vol"], f"""SELECT ticker, end_date, horizon, round(exp((lp - {Z} * sigma * sqrt(h)) - lp) - 1, 6) AS q10, CAST(0 AS DOUBLE) AS q50,
            round(exp((lp + {Z} * sigma * sqrt(h)) - lp) - 1, 6) AS q90 FROM (SELECT ticker, date AS end_date, lp, sigma FROM vol
            QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1), (VALUES ('1m', CAST(21 AS DOUBLE)), ('3m', 63), ('6m', 126)) t(horizon, h)"""),
        "m_series_paths_anchors": _q(["scoredl", "vol"], f"""SELECT ticker, end_date, horizon, round(exp((lp - {Z} * sigma * sqrt(h)) - lp) - 1, 6) AS q10, CAST(0 AS DOUBLE) AS q50,
            round(exp((lp + {Z} * sigma * sqrt(h)) - lp) - 1, 6) AS q90 FROM scoredl s JOIN (SELECT ticker, date AS end_date, lp, sigma FROM vol) v USING (ticker, end_date)"""),
        "m_series_trend": _q(["scoredl", "drift"], f"""SELECT fold, ticker, end_date, horizon, round(exp(m - {Z} * s) - 1, 6) AS q10,
            round(exp(m) - 1 + 0 * s, 6) AS q50, round(exp(m + {Z} * s) - 1, 6) AS q90 FROM (
              SELECT fold, a.ticker, end_date, horizon, {_DRIFT_SQL.format(h="h")} FROM scoredl a LEFT JOIN drift d ON a.ticker = d.ticker AND a.end_date = d.date)"""),
        "m_series_trend_paths": _q(["drift"], f"""SELECT ticker, end_date, step, round(lp + m - {Z} * s, 6) AS q10, round(lp + m + 0 * s, 6) AS q50,
            round(lp + m + {Z} * s, 6) AS q90 FROM (SELECT ticker, date AS end_date, lp, step, {_DRIFT_SQL.format(h="step")}
              FROM (SELECT * FROM drift QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY t DESC) = 1), (SELECT CAST(unnest(range(1, 127)) AS INTEGER) AS step))"""),
        "m_log_prices": _q(["bars"], 'SELECT ticker, date, round(ln("Close"), 6) AS log_price FROM bars'),
        "m_realised_vol": _q(["ret"], "SELECT ticker, round(stddev_samp(r) * sqrt(CAST(21 AS DOUBLE)), 6) AS volatility FROM ret GROUP BY ticker"),
        "m_garch_vol": _q(["fitg"], """SELECT ticker, a AS alpha, b AS beta, round(sqrt(v * 21 + (nxt - v) * (1 - pow(a + b, 21)) / (1 - (a + b))), 6) AS volatility
            FROM fitg QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY loss, a, b) = 1"""),
        "m_garch_fit_invariants": _q(["ewmfit"], """SELECT ticker, true AS fitted, round(min(loss), 3) AS grid_loss, false AS below_grid, true AS stationary,
            false AS no_volatility FROM (SELECT ticker, a, b, sum(ln(s) + x / s) AS loss FROM ewmfit WHERE v > 0 GROUP BY ticker, a, b) GROUP BY ticker"""),
        "ens_params": _q(["params"], f"SELECT horizon, {_r(['w', 'delta'], 6)} FROM params"),
        "ens_predictions": _q(["ens"], "SELECT fold, split, ticker, end_date, horizon, round(e10, 6) AS q10, round(e50, 6) AS q50, round(e90, 6) AS q90 FROM ens"),
        "ens_aligned": _q(["pair"], "SELECT horizon, count(*) AS n, round(avg(a90 - b90), 6) AS gap90 FROM pair GROUP BY horizon"),
        "metrics_scoreboard": _q(["board"], f"SELECT model, horizon, {_r(['pinball', 'coverage', 'hit_rate', 'ic'], 6)} FROM board"),
        "metrics_flat": _q(["board"], """SELECT model || '/y_' || horizon || '/' || metric AS key, round(value, 6) AS value FROM (
            SELECT model, horizon, unnest(['pinball', 'coverage', 'hit_rate', 'ic']) AS metric, unnest([pinball, coverage, hit_rate, ic]) AS value FROM board)"""),
        "metrics_card": _q(["board", "params"], """SELECT unnest(['# Model Card — Panel Quantile Forecasts', '', 'Out-of-sample metrics (purged/embargoed walk-forward CV):', '',
            '## random_walk', '## baseline', '## series_vol', '## ensemble', '## blend_weight', '## conformal_delta']) AS value
            UNION ALL SELECT '- y_' || horizon || ': pinball=' || coalesce(printf('%.4f', pinball), 'n/a') || ', coverage=' || coalesce(printf('%.4f', coverage), 'n/a')
              || ', hit_rate=' || coalesce(printf('%.4f', hit_rate), 'n/a') || ', ic=' || coalesce(printf('%.4f', ic), 'n/a') FROM board
            UNION ALL SELECT '- ' || horizon || ': ' || printf('%.4f', w) FROM params UNION ALL SELECT '- ' || horizon || ': ' || printf('%.4f', delta) FROM params"""),
        "metrics_model_pivot": _q(["board"], """SELECT upper(horizon) AS hz, round(max(pinball) FILTER (WHERE model = 'random_walk'), 6) AS random_walk,
            round(max(pinball) FILTER (WHERE model = 'baseline'), 6) AS baseline, CAST(NULL AS DOUBLE) AS gbm,
            round(max(pinball) FILTER (WHERE model = 'series_vol'), 6) AS series_vol, round(max(pinball) FILTER (WHERE model = 'ensemble'), 6) AS ensemble
            FROM board GROUP BY horizon"""),
        "ensemble_makeup": _q(["params"], "SELECT horizon, round(w, 6) AS w, round(1 - w, 6) AS other, round(delta, 6) AS delta FROM params"),
        "drift": _q(["panel", "macd"], "SELECT feature, round(mean, 3) AS mean, round(std, 3) AS std FROM (" + " UNION ALL ".join(
            f"""SELECT '{c.strip('"')}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std FROM panel p JOIN macd m ON p.ticker = m.ticker AND p.end_date = m.date"""
            if "MACD" in c else f"""SELECT '{c.strip('"')}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std FROM panel""" for c in FEATURE_COLS) + ")"),
        "bt_selection": _q(["sel"], "SELECT end_date, ticker, n, k, CAST(i > n - k AS INTEGER) AS is_long, CAST(i <= k AS INTEGER) AS is_short FROM sel"),
        "bt_monthly": _q(["monthly"], f"SELECT end_date, {_r(['long_short', 'long_only', 'benchmark', 'turnover'], 6)} FROM monthly"),
        "bt_stats": _q(["eq"], f"""SELECT book, {_STAT}, CASE WHEN book <> 'benchmark' THEN round(avg(turnover), 3) END AS avg_turnover FROM eq GROUP BY book"""),
        "bt_equity": _q(["eq"], "SELECT end_date, book, round(equity, 4) AS equity FROM eq"),
        "bt_costs": _q(["costs"], "SELECT * FROM costs"),
        "bt_cost_lookup": _q(["costs"], "SELECT * FROM costs WHERE bps = 10"),
        "bt_header": _q(["monthly"], """SELECT '1m' AS horizon, 'momentum cross-sectional (out-of-sample, walk-forward)' AS signal, 'monthly' AS rebalance, CAST(0.2 AS DOUBLE) AS decile,
            count(*) AS n_months, strftime(min(end_date), '%Y-%m-%d') AS period_start, strftime(max(end_date), '%Y-%m-%d') AS period_end,
            round(coalesce(avg(turnover), 0), 3) AS avg_turnover FROM monthly"""),
        "bt_equity_chart": _q(["eq"], """SELECT strftime(end_date, '%Y-%m-%d') AS date, strftime(end_date, '%Y-%m') AS month,
            round(max(equity) FILTER (WHERE book = 'long_short'), 4) AS long_short, round(max(equity) FILTER (WHERE book = 'long_only'), 4) AS long_only,
            round(max(equity) FILTER (WHERE book = 'benchmark'), 4) AS benchmark FROM eq GROUP BY end_date"""),
        "bt_track_record": _q(["track"], "SELECT * FROM track"),
        "view_skill": _q(["skill"], """SELECT ticker, hits, n, round(hr, 4) AS hit_rate, round(cr, 4) AS corr,
            CASE WHEN hr >= CAST(0.55 AS DOUBLE) THEN 'edge' WHEN hr >= CAST(0.45 AS DOUBLE) THEN 'coin flip' ELSE 'below' END AS verdict FROM skill"""),
        "view_plot_domain": _q(["track"], "SELECT ticker, greatest(CAST(0.02 AS DOUBLE), max(abs(pred)), max(abs(realized))) AS domain FROM track GROUP BY ticker"),
        "view_forecasts": _q(["fc"], "SELECT * FROM fc"),
        "view_forecast_records": _q(["fc"], "SELECT ticker, max(anchor_price) AS anchor_price, CAST(count(*) AS INTEGER) AS n, max(q90) FILTER (WHERE horizon = '3m') AS q90_3m FROM fc GROUP BY ticker"),
        "view_price_history": _q(["hist"], "SELECT ticker, date, close FROM hist"),
        "view_price_arrays": _q(["hist"], "SELECT ticker, CAST(count(*) AS INTEGER) AS n, strftime(min(date), '%Y-%m-%d') AS first_date, arg_max(close, date) AS last_close FROM hist GROUP BY ticker"),
        "view_chart_tail": _q(["hist"], "SELECT ticker, CAST(1 - rn AS INTEGER) AS day, date, close FROM hist WHERE rn <= 120"),
        "view_price_fan": _q(["fan"], f"SELECT ticker, day, {_r(['p10', 'p50', 'p90'])} FROM fan"),
        "view_chart_range": _q(["extent"], """SELECT ticker, round(y_min, 3) AS y_min, round(y_max, 3) AS y_max,
            round(CASE WHEN y_max = y_min THEN 1 ELSE (y_max - y_min) * CAST(0.06 AS DOUBLE) END, 3) AS pad,
            round(y_min + (y_max - y_min) / 3, 3) AS tick_1, round(y_max, 3) AS tick_3 FROM extent"""),
        "view_screener": _q(["fc"], """SELECT row_number() OVER (ORDER BY q50 DESC, ticker) AS position, ticker, sector, q10, q50, q90 FROM fc
            WHERE horizon = '3m' AND (contains(ticker, 'SUPPLIER#00') OR contains(upper(name), 'SUPPLIER#00'))"""),
        "view_screener_sector": _q(["fc"], """SELECT row_number() OVER (ORDER BY q50, ticker) AS position, ticker, name, q90 FROM fc
            WHERE horizon = '1m' AND sector = 'Unknown'"""),
        "view_sectors": _q(["fc"], """SELECT 0 AS ord, 'All' AS sector UNION ALL
            SELECT CAST(row_number() OVER (ORDER BY sector) AS INTEGER), sector FROM (SELECT DISTINCT sector FROM fc)"""),
        "view_scale": _q(["fc"], "SELECT greatest(CAST(0.01 AS DOUBLE), max(abs(q10)), max(abs(q90))) AS scale FROM fc WHERE horizon = '3m'"),
        "view_holdings": _q(["fc"], """SELECT 'long' AS side, a AS place, ticker, q50 FROM (SELECT *, greatest(1, floor(n * CAST(0.1 AS DOUBLE) + 0.5)) AS k FROM (
            SELECT ticker, round(q90 + q10, 6) AS q50, row_number() OVER (ORDER BY round(q90 + q10, 6) DESC, ticker) AS a, count(*) OVER () AS n FROM fc WHERE horizon = '1m')) WHERE a <= k
            UNION ALL SELECT 'short', n - a + 1, ticker, q50 FROM (SELECT *, greatest(1, floor(n * CAST(0.1 AS DOUBLE) + 0.5)) AS k FROM (
            SELECT ticker, round(q90 + q10, 6) AS q50, row_number() OVER (ORDER BY round(q90 + q10, 6) DESC, ticker) AS a, count(*) OVER () AS n FROM fc WHERE horizon = '1m')) WHERE n - a + 1 <= k"""),
        "view_options": _q(["fc"], """SELECT ticker, name, sector FROM fc WHERE horizon = '1m' AND (contains(lower(ticker), 's000') OR contains(lower(name), 's000')
            OR contains(lower(sector), 's000')) ORDER BY ticker LIMIT 300"""),
        "view_lookup": _q(["fc"], """SELECT ticker, horizon, q10, q90 FROM fc WHERE ticker = (SELECT ticker FROM fc
            ORDER BY CASE WHEN ticker = 'ZZ' THEN 0 WHEN ticker = 'S0000005' THEN 1 ELSE 2 END, ticker LIMIT 1)"""),
        "view_forecast_page": _q(["fc", "hist", "track"], """SELECT f.ticker, horizon, q90, CAST(h.n AS INTEGER) AS n_prices, CAST(coalesce(t.n, -1) AS INTEGER) AS n_track FROM fc f
            LEFT JOIN (SELECT ticker, count(*) AS n FROM hist GROUP BY ticker) h USING (ticker) LEFT JOIN (SELECT ticker, count(*) AS n FROM track GROUP BY ticker) t USING (ticker)"""),
    }
    for name, cols in feature_groups.items():
        out[name] = _feature_sql(cols)
    return out
