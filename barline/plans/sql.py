"""SQL pieces over the given tables for checks by another engine."""

from __future__ import annotations

PRICE_ORDER = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, p"


def _moves(source: str) -> str:
    """Up and down moves of the close, true range and directional moves of bars or of the panel with its gaps."""
    return f"""SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS down, CASE WHEN hu > ld AND hu > 0 THEN hu ELSE 0.0 END AS plus, CASE WHEN ld > hu AND ld > 0 THEN ld ELSE 0.0 END AS minus,
        greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, close - lag(close) OVER w AS d, lag(close) OVER w AS pc, high - lag(high) OVER w AS hu, lag(low) OVER w - low AS ld FROM {source} WINDOW w AS (PARTITION BY asset ORDER BY date))"""


CTES: dict[str, str] = {
    "bars": f"""SELECT l_returnflag || l_linestatus AS asset, CAST(l_shipdate AS DATE) AS date, first(p {PRICE_ORDER}) AS open, max(p) AS high, min(p) AS low, last(p {PRICE_ORDER}) AS close, sum(l_quantity) AS volume
        FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2""",
    "sess": "SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM bars) WHERE isodow(d) < 6",
    "panel": "SELECT a.asset, s.date, b.open, b.high, b.low, b.close, b.volume FROM (SELECT DISTINCT asset FROM bars) a CROSS JOIN sess s LEFT JOIN bars b ON a.asset = b.asset AND s.date = b.date",
    "rates": "SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1e5 AS percent FROM orders GROUP BY 1",
    "rf": "SELECT date, last_value(percent IGNORE NULLS) OVER (ORDER BY date) / 100 AS risk_free_annual FROM (SELECT s.date, r.percent FROM sess s LEFT JOIN rates r ON s.date = r.date WHERE s.date >= (SELECT min(date) FROM rates))",
    "trades_in": "SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag || l_linestatus AS asset, sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE -l_quantity END) / 3 AS delta_shares FROM lineitem GROUP BY 1, 2",
    "ret": "SELECT * FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY date)) AS r FROM bars) WHERE r IS NOT NULL",
    "mkt": "SELECT date, avg(r) AS m FROM ret GROUP BY date",
    "retm": "SELECT ret.*, m FROM ret JOIN mkt USING (date)",
    "wealth": "SELECT *, exp(sum(r) OVER (PARTITION BY asset ORDER BY date)) AS wealth FROM ret",
    "dd": "SELECT *, wealth / max(wealth) OVER (PARTITION BY asset ORDER BY date) - 1 AS drawdown FROM wealth",
    "pairs": "SELECT a.date, a.r AS r1, b.r AS r2, m FROM ret a JOIN ret b ON a.date = b.date AND a.asset = 'AF' AND b.asset = 'RO' JOIN mkt ON a.date = mkt.date",
    "mom": "SELECT avg(r1) AS e1, avg(r2) AS e2, avg(m) AS em, var_samp(r1) AS v1, var_samp(r2) AS v2, var_samp(m) AS vm, covar_samp(r1, r2) AS c12, covar_samp(r1, m) AS c1m, covar_samp(r2, m) AS c2m FROM pairs",
    "grid": "SELECT k / 100 AS w, w * e1 + (1 - w) * e2 AS mean, w * w * v1 + (1 - w) * (1 - w) * v2 + 2 * w * (1 - w) * c12 AS variance, w * c1m + (1 - w) * c2m AS cov_m, em, vm FROM mom, range(0, 101) t(k)",
    "terms": """SELECT asset, date, open, high, low, close, CASE WHEN n = 2 THEN b END AS beta, CASE WHEN n = 2 THEN pow(ln(h / l), 2) END AS gamma FROM (
        SELECT *, count(*) OVER w2 AS n, sum(pow(ln(high / low), 2)) OVER w2 AS b, max(high) OVER w2 AS h, min(low) OVER w2 AS l FROM bars WINDOW w2 AS (PARTITION BY asset ORDER BY date ROWS 1 PRECEDING))""",
    "spreads": """SELECT *, 2 * (exp(alpha) - 1) / (1 + exp(alpha)) AS spread FROM (SELECT *,
        CASE WHEN beta IS NOT NULL THEN greatest((sqrt(2) - 1) / (3 - 2 * sqrt(2)) * sqrt(beta) - sqrt(gamma / (3 - 2 * sqrt(2))), 0) END AS alpha,
        CASE WHEN beta IS NOT NULL THEN greatest((pow(2, -0.5) - 1) * sqrt(beta) / (sqrt(8 / pi()) * (3 - 2 * sqrt(2))) + sqrt(gamma / (8 / pi() * (3 - 2 * sqrt(2)))), 0) END AS sigma,
        lead(open) OVER (PARTITION BY asset ORDER BY date) AS next_open FROM terms)""",
    "moves": _moves("bars"),
    "panel_moves": _moves("panel"),
    "accrued": """SELECT date, rate, days_to_next, factor, ln(factor) AS log_factor, CASE WHEN factor IS NOT NULL THEN exp(sum(ln(factor)) OVER (ORDER BY date)) END AS close FROM (
        SELECT date, rate, coalesce(date_diff('day', date, ahead), 1) AS days_to_next, CASE WHEN ahead IS NULL THEN 1.0 ELSE 1 + rate * date_diff('day', date, ahead) / 360 END AS factor FROM (
        SELECT date, last_value(risk_free_annual IGNORE NULLS) OVER (ORDER BY date) AS rate, lead(date) OVER (ORDER BY date) AS ahead FROM (SELECT d.date, rf.risk_free_annual FROM (SELECT DISTINCT date FROM bars) d LEFT JOIN rf ON d.date = rf.date)))""",
    "trades": "SELECT o.date, o.asset, o.delta_shares AS q, s.next_open AS p_ref, s.next_open * (CASE WHEN o.delta_shares >= 0 THEN 1 + coalesce(s.spread, 0) / 2 ELSE 1 - coalesce(s.spread, 0) / 2 END) AS p_exec, s.sigma FROM trades_in o LEFT JOIN spreads s ON o.date = s.date AND o.asset = s.asset",
}
#: What each piece reads.
NEEDS = {
    "sess": ["bars"], "panel": ["bars", "sess"], "rf": ["bars", "sess", "rates"], "ret": ["bars"], "mkt": ["ret"], "retm": ["ret", "mkt"], "wealth": ["ret"], "dd": ["wealth"], "pairs": ["ret", "mkt"], "mom": ["pairs"], "grid": ["mom"],
    "terms": ["bars"], "spreads": ["terms"], "moves": ["bars"], "panel_moves": ["panel"], "accrued": ["bars", "rf"], "trades": ["trades_in", "spreads"],
}


def cut(value: str, digits: int) -> str:
    """A value on a decimal grid, set off from the usual ties so that rounding errors do not show."""
    return f"floor(({value}) * 1e{digits} + 0.3) / 1e{digits}"


def smoothed(name: str, source: str, value: str, alpha: str) -> dict[str, str]:
    """Pieces that smooth a value over the rows that have one: name(asset, date, y, rn), one row for each of source.

    A row without a value has the last y and the count rn so far; a gap of k rows weighs what came before it by
    (1 - alpha) ** k.
    """
    d = f"pow(1 - {alpha}, s.k)"
    return {
        f"{name}_x": f"SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn, pos - lag(pos) OVER (PARTITION BY asset ORDER BY date) AS k FROM (SELECT asset, date, {value} AS x, row_number() OVER (PARTITION BY asset ORDER BY date) AS pos FROM {source}) WHERE x IS NOT NULL",
        f"{name}_r": f"SELECT asset, date, rn, x AS y FROM {name}_x WHERE rn = 1 UNION ALL SELECT s.asset, s.date, s.rn, ({d} * e.y + {alpha} * s.x) / ({d} + {alpha}) FROM {name}_r e JOIN {name}_x s ON s.asset = e.asset AND s.rn = e.rn + 1",
        name: f"SELECT s.asset, s.date, last_value(r.y IGNORE NULLS) OVER w AS y, last_value(r.rn IGNORE NULLS) OVER w AS rn FROM {source} s LEFT JOIN {name}_r r ON s.asset = r.asset AND s.date = r.date WINDOW w AS (PARTITION BY s.asset ORDER BY s.date)",
    }


def query(body: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """A statement with the pieces it needs before it, in order."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in needs:
        need(n)
    pieces = {n: CTES[n] for n in order} | (extra or {})
    listed = ",\n".join(f"{n} AS {'' if 'UNION ALL' in q and n in q else 'MATERIALIZED '}({q})" for n, q in pieces.items())
    return f"WITH RECURSIVE {listed}\n{body}" if pieces else body
