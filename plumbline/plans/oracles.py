"""Equivalent SQL for the queries, built from the datasets' own texts."""

from __future__ import annotations

from plumbline.sources.datasets import text

DRAWS = 99


def rnd(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def linear_system(source: str, cols: list[str], rhs: list[str], weight: str = "1.0", extra: tuple[str, ...] = (), units: bool = False, p: str = "", by: str = "", guard: bool = False) -> tuple[str, list[list[str]]]:
    """CTEs that solve (X'X) b = X'r for every r (and unit vectors), by elimination on sums; returns names of the solutions.

    ``source`` is a relation; ``cols`` and ``rhs`` are expressions over it.  The last CTE is ``solved`` (one row, or one for
    each value of column ``by``); ``p`` goes before all CTEs' names.
    """
    k = len(cols)
    every = [f"sum(({a}) * ({b}) * ({weight})) AS a0_{i}_{j}" for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    every += [f"sum(({a}) * ({b}) * ({weight})) AS r0_{i}_{m}" for i, a in enumerate(cols) for m, b in enumerate(rhs)]
    every += [f"sum(({a}) * ({b}) * ({weight})) AS rr_{m}_{n}" for m, a in enumerate(rhs) for n, b in enumerate(rhs) if n >= m]
    total = len(rhs) + (k if units else 0)
    if units:
        every += [f"CAST({int(i == j)} AS DOUBLE) AS r0_{i}_{len(rhs) + j}" for i in range(k) for j in range(k)]
    first = f"SELECT {by + ', ' if by else ''}count(*) AS n, {', '.join([*every, *extra])} FROM {source}{f' GROUP BY {by}' if by else ''}"
    return eliminated(first, k, total, p, guard)


def eliminated(first: str, k: int, total: int, p: str = "", guard: bool = False) -> tuple[str, list[list[str]]]:
    """CTEs that solve the k x k symmetric systems of ``first`` (a0_i_j for i <= j, right-hand sides r0_i_m); ``guard``: a column of zeros gets 0."""
    by = (lambda x: f"CASE WHEN abs({x}) > 1e-9 THEN {x} ELSE 1e300 END") if guard else str
    ctes = [f"{p}g0 AS ({first})"]
    sym = lambda q, i, j: f"a{q}_{min(i, j)}_{max(i, j)}"
    for q in range(k - 1):
        step = [f"{sym(q, i, j)} - {sym(q, q, i)} * {sym(q, q, j)} / {by(sym(q, q, q))} AS a{q + 1}_{i}_{j}" for i in range(q + 1, k) for j in range(i, k)]
        step += [f"r{q}_{i}_{m} - {sym(q, q, i)} * r{q}_{q}_{m} / {by(sym(q, q, q))} AS r{q + 1}_{i}_{m}" for i in range(q + 1, k) for m in range(total)]
        ctes.append(f"{p}g{q + 1} AS (SELECT *, {', '.join(step)} FROM {p}g{q})")
    last = f"{p}g{k - 1}"
    for i in reversed(range(k)):
        back = []
        for m in range(total):
            terms = "".join(f" - {sym(i, i, j)} * b{j}_{m}" for j in range(i + 1, k))
            back.append(f"(r{i}_{i}_{m}{terms}) / {by(sym(i, i, i))} AS b{i}_{m}")
        ctes.append(f"{p}s{i} AS (SELECT *, {', '.join(back)} FROM {last})")
        last = f"{p}s{i}"
    ctes.append(f"{p}solved AS (SELECT * FROM {last})")
    return ",\n".join(ctes), [[f"b{i}_{m}" for i in range(k)] for m in range(total)]


def rows(pairs: list[tuple[str, str]], source: str = "solved", digits: int = 6, names=("param", "estimate")) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS {names[0]}, {rnd(e, digits)} AS {names[1]} FROM {source}" for n, e in pairs)


def ols(data: str, y: str, x: list[str], names: list[str], weight: str = "1.0") -> str:
    ctes, b = linear_system("d", x, [y], weight)
    return f"WITH d AS ({data}), {ctes} {rows(list(zip(names, b[0])))}"


def sign(seed: int, key: str, b: str) -> str:
    return f"CASE WHEN substr(md5(concat('{seed}', ':', CAST({key} AS VARCHAR), ':', CAST({b} AS VARCHAR))), 1, 1) < '8' THEN 1.0 ELSE -1.0 END"


SQL: dict[str, str] = {}
LINES, PANEL, IVSET, RCT, GAPPY, SPEND, EDGES, NATIONS, MONTHLY, ORDERED = (text(n) for n in ("lines", "panel", "ivset", "rct", "gappy", "spend", "edges", "nations", "monthly", "ordered"))
X = ["q", "d", "x", "1.0"]
NAMES = ["q", "d", "x", "_cons"]

SQL["ols_simple"] = ols(LINES, "y", ["q", "1.0"], ["q", "_cons"])
SQL["ols_multi"] = ols(LINES, "y", X, NAMES)
SQL["ols_categorical"] = ols(LINES, "y", ["q", "CASE WHEN flag = 'N' THEN 1.0 ELSE 0.0 END", "CASE WHEN flag = 'R' THEN 1.0 ELSE 0.0 END", "1.0"], ["q", "flag_N", "flag_R", "_cons"])
_c, _b = linear_system("d", ["q", "d + x", "1.0"], ["y"])
SQL["ols_constrained"] = f"WITH d AS ({LINES}), {_c} {rows([('q', _b[0][0]), ('d', _b[0][1]), ('x', _b[0][1]), ('_cons', _b[0][2])])}"

_c, _b = linear_system("dat", X, ["y"], units=True)
_u = "(y - q * b0_0 - d * b1_0 - x * b2_0 - b3_0)"
_scores = f"""dat AS ({LINES}), {_c},
scores AS (SELECT supp, sum(q * {_u}) AS s0, sum(d * {_u}) AS s1, sum(x * {_u}) AS s2, sum({_u}) AS s3 FROM dat CROSS JOIN solved GROUP BY supp)"""
SQL["ols_cluster_scores"] = f"WITH {_scores} SELECT supp, {', '.join(f'{rnd(f's{i}', 4)} AS s_{n}' for i, n in enumerate(('q', 'd', 'x', 'cons')))} FROM scores"
_dev = [" + ".join(f"{_b[1 + j][i]} * z{j}" for j in range(4)) for i in range(4)]
SQL["ols_cluster_boot_se"] = f"""WITH {_scores},
sums AS (SELECT b, {', '.join(f"sum(({sign(7, 'supp', 'b')}) * s{j}) AS z{j}" for j in range(4))} FROM scores CROSS JOIN range({DRAWS}) r(b) GROUP BY b),
k AS (SELECT count(*) AS g FROM scores),
se AS (SELECT {', '.join(f'stddev_samp({e}) AS e{i}' for i, e in enumerate(_dev))} FROM sums CROSS JOIN solved),
f AS (SELECT *, sqrt((n - 1.0) / (n - 4.0) * g / (g - 1.0)) AS c FROM solved CROSS JOIN k CROSS JOIN se)
{' UNION ALL '.join(f"SELECT '{n}' AS param, {rnd(f'b{i}_0')} AS estimate, {rnd(f'c * e{i}')} AS se FROM f" for i, n in enumerate(NAMES))}"""

_c, _b = linear_system("dat", ["x", "1.0"], ["y"], units=True)
_dev = [" + ".join(f"{_b[1 + j][i]} * z{j}" for j in range(2)) for i in range(2)]
SQL["ols_enum_boot_region"] = f"""WITH dat AS ({SPEND}), {_c},
scores AS (SELECT region, sum(x * (y - x * b0_0 - b1_0)) AS s0, sum(y - x * b0_0 - b1_0) AS s1 FROM dat CROSS JOIN solved GROUP BY region),
ranked AS (SELECT *, row_number() OVER (ORDER BY region) - 1 AS j FROM scores),
sums AS (SELECT b, sum((2 * ((b >> j::BIGINT) & 1) - 1) * s0) AS z0, sum((2 * ((b >> j::BIGINT) & 1) - 1) * s1) AS z1 FROM ranked CROSS JOIN range(32) r(b) GROUP BY b),
k AS (SELECT count(*) AS g FROM scores),
se AS (SELECT {', '.join(f'stddev_samp({e}) AS e{i}' for i, e in enumerate(_dev))} FROM sums CROSS JOIN solved),
f AS (SELECT *, sqrt((n - 1.0) / (n - 2.0) * g / (g - 1.0)) AS c FROM solved CROSS JOIN k CROSS JOIN se)
{' UNION ALL '.join(f"SELECT '{n}' AS param, {rnd(f'b{i}_0')} AS estimate, {rnd(f'c * e{i}')} AS se FROM f" for i, n in enumerate(('x', '_cons')))}"""

_within = f"SELECT {', '.join(f'{c} - avg({c}) OVER (PARTITION BY supp) AS {c}' for c in ('y', 'q', 'd'))} FROM ({LINES}) WHERE supp IN (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(*) > 1)"
SQL["fe_oneway"] = ols(_within, "y", ["q", "d"], ["q", "d"])
_two = f"""WITH p AS ({PANEL}), w AS (SELECT y - avg(y) OVER (PARTITION BY id) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y,
    treat - avg(treat) OVER (PARTITION BY id) - avg(treat) OVER (PARTITION BY t) + avg(treat) OVER () AS d FROM p)
    SELECT {rnd('sum(y * d) / sum(d * d)')} AS estimate FROM w"""
SQL["fe_twoway_balanced"] = SQL["fe_twoway_iterated"] = _two
# Customers' years with orders only: not balanced.  Customers' means out, years as dummies; singletons fit themselves.
_years = [f"CASE WHEN t = {y} THEN 1.0 ELSE 0.0 END" for y in range(1996, 2002)]
_cols = ["y", "x", *_years]
_un, _b = linear_system("w", ["c1", *[f"c{i + 2}" for i in range(6)]], ["c0"])
SQL["fe_twoway_unbalanced"] = f"""WITH p AS ({ORDERED}), w AS (SELECT {', '.join(f'({c}) - avg({c}) OVER (PARTITION BY id) AS c{i}' for i, c in enumerate(_cols))} FROM p), {_un}
    SELECT {rnd(_b[0][0])} AS estimate FROM solved"""
SQL["fe_singletons"] = f"""WITH p AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM ({GAPPY}))
    SELECT count(*) FILTER (WHERE n > 1) AS kept, {rnd('sum(v) FILTER (WHERE n > 1)', 2)} AS v, count(*) FILTER (WHERE n = 1) AS dropped FROM p"""
SQL["fe_dof"] = f"""WITH RECURSIVE p AS (SELECT DISTINCT 'a' || nation AS a, 'b' || segment AS b FROM ({SPEND})),
    e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p),
    reach(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v),
    c AS (SELECT count(DISTINCT m) AS n FROM (SELECT u, min(v) AS m FROM reach GROUP BY u))
    SELECT 'nation' AS fe, count(DISTINCT a) AS levels, CAST(1 AS BIGINT) AS redundant FROM p
    UNION ALL SELECT 'segment', count(DISTINCT b), (SELECT n FROM c) FROM p"""
SQL["fe_nested"] = f"""WITH p AS ({SPEND})
    SELECT 'nation' AS low, 'region' AS high, max(n) = 1 AS nested FROM (SELECT nation, count(DISTINCT region) AS n FROM p GROUP BY nation)
    UNION ALL SELECT 'segment', 'region', max(n) = 1 FROM (SELECT segment, count(DISTINCT region) AS n FROM p GROUP BY segment)"""

SQL["panel_lag_gap"] = f"WITH p AS ({GAPPY}) SELECT a.id, a.t, a.v, b.v AS lag1 FROM p a LEFT JOIN p b ON b.id = a.id AND b.t = a.t - 1"
SQL["panel_lead"] = f"WITH p AS ({GAPPY}) SELECT a.id, a.t, a.v, b.v AS lead1 FROM p a LEFT JOIN p b ON b.id = a.id AND b.t = a.t + 1"
SQL["panel_diff2"] = f"""WITH p AS ({GAPPY}) SELECT a.id, a.t, (a.v - b.v) - (b.v - c.v) AS diff2 FROM p a
    LEFT JOIN p b ON b.id = a.id AND b.t = a.t - 1 LEFT JOIN p c ON c.id = b.id AND c.t = b.t - 1"""
SQL["panel_lag_range"] = f"""WITH p AS ({GAPPY}) SELECT a.id, a.t, b.v AS lag1, c.v AS lag2, d.v AS lag3 FROM p a
    {' '.join(f'LEFT JOIN p {n} ON {n}.id = a.id AND {n}.t = a.t - {i}' for i, n in enumerate('bcd', 1))}"""
SQL["panel_segments"] = f"""WITH p AS (SELECT id, t, CASE WHEN t - lag(t) OVER (PARTITION BY id ORDER BY t) <> 1 THEN 1 ELSE 0 END AS gap FROM ({GAPPY}))
    SELECT id, t, CAST(sum(gap) OVER (PARTITION BY id ORDER BY t) AS BIGINT) AS segment FROM p"""
SQL["first_treated"] = f"SELECT id, CAST(coalesce(min(t) FILTER (WHERE treat = 1), 0) AS BIGINT) AS g FROM ({PANEL}) GROUP BY id"

_pairs = [(a, b) for i, a in enumerate(("q", "d", "x", "y")) for b in ("q", "d", "x", "y")[i:]]
SQL["gram_weighted"] = f"WITH d AS ({LINES}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a} * {b} * q) / count(*), 6) AS mean FROM d" for a, b in _pairs)
SQL["col_var_weighted"] = f"""WITH d AS ({LINES}), s AS (SELECT sum(q) AS w, sum(q * q) AS w2, sum(q * y) / sum(q) AS m, count(*) AS n FROM d),
    v AS (SELECT sum(q * (y - m) * (y - m)) AS ss FROM d CROSS JOIN s)
    SELECT {rnd('m')} AS mean, {rnd('ss / (w - w2 / w)')} AS var_unbiased, {rnd('ss / w * n / (n - 1)')} AS var_pweight FROM s CROSS JOIN v"""
SQL["leverage"] = f"""WITH d AS ({SPEND}), s AS (SELECT count(*) AS n, avg(x) AS m, sum(x * x) - count(*) * avg(x) * avg(x) AS ss FROM d)
    SELECT id, {rnd('1.0 / n + (x - m) * (x - m) / ss', 8)} AS leverage FROM d CROSS JOIN s"""
SQL["quantile_type1"] = "SELECT o_orderpriority, quantile_disc(o_totalprice, 0.25) AS q25, quantile_disc(o_totalprice, 0.5) AS q50, quantile_disc(o_totalprice, 0.75) AS q75 FROM orders GROUP BY o_orderpriority"
_totals = f"""WITH z AS (SELECT b, sum(({sign(5, 's_suppkey', 'b')}) * s_acctbal) / 1000 AS v FROM supplier CROSS JOIN range({DRAWS}) r(b) GROUP BY b),
    o AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM z)"""
SQL["bplus1_quantile"] = f"{_totals} SELECT {rnd('v')} AS value FROM o WHERE i = ceil(0.95 * {DRAWS + 1} - 1e-9)"
SQL["draw_iqr_band"] = f"""{_totals}, w AS (SELECT (max(v) FILTER (WHERE i = ceil(0.75 * {DRAWS})) - max(v) FILTER (WHERE i = ceil(0.25 * {DRAWS}))) / 1.3489795003921634 AS se FROM o),
    c AS (SELECT m AS crit FROM (SELECT abs(v / se) AS m, row_number() OVER (ORDER BY abs(v / se)) AS i FROM z CROSS JOIN w) WHERE i = ceil(0.95 * {DRAWS + 1} - 1e-9))
    SELECT {rnd('se')} AS se, {rnd('5 - crit * se')} AS lower, {rnd('5 + crit * se')} AS upper FROM w CROSS JOIN c"""
SQL["ssc_factor"] = "SELECT count(*) AS n, count(DISTINCT l_suppkey) AS g, round(sqrt((count(*) - 1.0) / (count(*) - 4.0) * count(DISTINCT l_suppkey) / (count(DISTINCT l_suppkey) - 1.0)), 10) AS factor FROM lineitem"


def _meat(ways: list[tuple[str, int]]) -> str:
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    c, _ = linear_system("dat", X, ["y"])
    parts = [f"SELECT {', '.join(f'{s} * sum(s{i} * s{j}) AS m{i}{j}' for i, j in pairs)} FROM (SELECT sum(q * {_u}) AS s0, sum(d * {_u}) AS s1, sum(x * {_u}) AS s2 FROM dat CROSS JOIN solved GROUP BY {w})" for w, s in ways]
    total = ", ".join(f"sum(m{i}{j}) / any_value(n) AS v{i}{j}" for i, j in pairs)
    return f"""WITH dat AS ({LINES}), {c}, parts AS ({' UNION ALL '.join(parts)}), total AS (SELECT {total} FROM parts CROSS JOIN (SELECT n FROM solved))
    {' UNION ALL '.join(f"SELECT '{NAMES[i]}' AS a, '{NAMES[j]}' AS b, round(v{i}{j}, 5) AS value FROM total" for i, j in pairs)}"""


SQL["moment_cov_oneway"] = _meat([("supp", 1)])
SQL["moment_cov_multiway"] = _meat([("supp", 1), ("part", 1), ("supp, part", -1)])

# Elimination column by column; a pivot that is nothing next to its column's square sum takes no row out and does not count.
_five = ["q", "2 * q", "d", "x", "d + x"]
_el = [f"p0 AS (SELECT {', '.join(f'sum(({a}) * ({b})) AS a0_{i}_{j}' for i, a in enumerate(_five) for j, b in enumerate(_five) if j >= i)} FROM ({LINES}))"]
for _q in range(5):
    _live = f"(a{_q}_{_q}_{_q} > 1e-9 * a0_{_q}_{_q})"
    _step = [f"a{_q}_{i}_{j} - CASE WHEN {_live} THEN a{_q}_{_q}_{i} * a{_q}_{_q}_{j} / a{_q}_{_q}_{_q} ELSE 0 END AS a{_q + 1}_{i}_{j}" for i in range(_q + 1, 5) for j in range(i, 5)]
    _el.append(f"p{_q + 1} AS (SELECT *, {', '.join([*_step, f'CAST({_live} AS BIGINT) AS k{_q}'])} FROM p{_q})")
SQL["collinear_columns"] = f"WITH {', '.join(_el)} SELECT CAST({' + '.join(f'k{q}' for q in range(5))} AS BIGINT) AS rank FROM p5"

# Two-stage least squares: fitted values of x, then least squares; exogenous w and a constant.
Z = ["z1", "z2", "w", "1.0"]
_first, _ = linear_system("dat", Z, ["x"])
_fit = "(z1 * b0_0 + z2 * b1_0 + w * b2_0 + b3_0)"
_second, _ = linear_system("hat", ["xh", "w", "1.0"], ["y"], p="two_")
_IV = f"WITH dat AS ({IVSET}), {_first}, hat AS (SELECT dat.*, {_fit} AS xh FROM dat CROSS JOIN solved), {_second}, two AS (SELECT * FROM two_solved)"
SQL["iv_2sls"] = SQL["gmm_2sls"] = f"{_IV} {rows([('x', 'b0_0'), ('w', 'b1_0'), ('_cons', 'b2_0')], 'two')}"
_res, _ = linear_system("dat", ["w", "1.0"], ["x"])
SQL["iv_partial_f"] = f"""WITH dat AS ({IVSET}), {_first}, full_fit AS (SELECT sum((x - {_fit}) * (x - {_fit})) AS full_rss, count(*) AS n FROM dat CROSS JOIN solved),
    part AS (SELECT regr_slope(x, w) AS s, regr_intercept(x, w) AS i FROM dat), small AS (SELECT sum((x - s * w - i) * (x - s * w - i)) AS small_rss FROM dat CROSS JOIN part)
    SELECT 'partial_f_x' AS metric, {rnd('(small_rss - full_rss) / 2.0 / (full_rss / (n - 4.0))', 4)} AS value FROM full_fit CROSS JOIN small"""
_e = "(hat.y - hat.x * two.b0_0 - hat.w * two.b1_0 - two.b2_0)"
_over, _ = linear_system("res", Z, ["e"], p="three_")
_over += ", three AS (SELECT * FROM three_solved)"
SQL["iv_sargan"] = f"""{_IV}, res AS (SELECT z1, z2, w, {_e} AS e FROM hat CROSS JOIN two), {_over},
    q AS (SELECT sum(e * (z1 * b0_0 + z2 * b1_0 + w * b2_0 + b3_0)) AS explained, sum(e * e) AS ee, count(*) AS n FROM res CROSS JOIN three)
    SELECT 'sargan' AS metric, {rnd('explained / (ee / (n - 3.0))', 4)} AS value FROM q"""

# event studies
_cells = f"""p AS ({PANEL}), cells AS (SELECT DISTINCT c.g, v.t, CASE WHEN v.t >= c.g THEN c.g - 1 ELSE v.t - 1 END AS base
    FROM p c CROSS JOIN (SELECT DISTINCT t FROM p) v WHERE c.g > 0 AND v.t > 1995)"""


def _dy(control: str = "p.g = 0 OR p.g > c.t", who: str = "TRUE", prefix: str = "") -> str:
    return f"""{prefix}rows AS (SELECT c.g, c.t, p.id, p.cluster, p.x, CASE WHEN p.g = c.g THEN 1.0 ELSE 0.0 END AS d, p.y - q.y AS dy FROM cells c
    JOIN p ON p.t = c.t AND (p.g = c.g OR {control}) AND p.{who} JOIN p q ON q.id = p.id AND q.t = c.base)""".replace("p.TRUE", "TRUE")


def _att(prefix: str = "", expr: str = "dy") -> str:
    return f"""{prefix}att AS (SELECT g, t, t - g AS tau, sum(d * {expr}) / sum(d) - sum((1 - d) * {expr}) / sum(1 - d) AS att, CAST(sum(d) AS BIGINT) AS n_treat,
    sum(d * {expr}) / sum(d) AS m1, sum((1 - d) * {expr}) / sum(1 - d) AS m0, sum(1 - d) AS n0 FROM {prefix}rows GROUP BY g, t)"""


_ES = f"WITH {_cells}, {_dy()}, {_att()}"
SQL["es_cells"] = f"WITH {_cells} SELECT CAST(g AS BIGINT) AS g, CAST(t AS BIGINT) AS t, CAST(base AS BIGINT) AS base FROM cells"
_gt = f"SELECT CAST(g AS BIGINT) AS g, CAST(t AS BIGINT) AS t, CAST(tau AS INT) AS tau, {rnd('att')} AS att, n_treat FROM att"
SQL["es_att_gt"] = f"{_ES} {_gt}"
SQL["es_att_gt_never"] = f"WITH {_cells}, {_dy('p.g = 0')}, {_att()} {_gt}"
_sizes = "sizes AS (SELECT g, count(DISTINCT id) AS n FROM p WHERE g > 0 GROUP BY g)"
_tau = lambda w: f"SELECT CAST(tau AS INT) AS tau, {rnd(f'sum({w} * att) / sum({w})')} AS att FROM att JOIN sizes USING (g) GROUP BY tau"
SQL["es_att_tau_equal"] = f"{_ES}, {_sizes} {_tau('1.0')}"
SQL["es_att_tau_group"] = f"{_ES}, {_sizes} {_tau('n')}"
SQL["es_att_tau_treated_t"] = f"{_ES}, {_sizes} {_tau('n_treat')}"
SQL["es_post_att"] = f"""{_ES}, {_sizes}, taus AS (SELECT tau, sum(n * att) / sum(n) AS att, sum(n) AS w FROM att JOIN sizes USING (g) WHERE tau >= 0 GROUP BY tau)
    SELECT 'post_att' AS param, {rnd('sum(w * att) / sum(w)')} AS estimate FROM taus"""
SQL["es_balance_e"] = f"""{_ES} SELECT CAST(tau AS INT) AS tau, {rnd('avg(att)')} AS att FROM att WHERE g IN (SELECT g FROM att WHERE tau = 3) AND tau <= 3 GROUP BY tau"""
SQL["dr_const_only"] = f"{_ES} SELECT CAST(g AS BIGINT) AS g, CAST(t AS BIGINT) AS t, {rnd('att')} AS att FROM att"
SQL["es_supt_band"] = f"""{_ES}, share AS (SELECT tau, count(*) AS cells FROM att GROUP BY tau),
    seen AS (SELECT g, t, CAST(count(DISTINCT cluster) AS DOUBLE) AS k FROM rows GROUP BY g, t),
    psi AS (SELECT tau, cluster, sum((d * (dy - m1) / n_treat - (1 - d) * (dy - m0) / n0) / cells * sqrt(k / (k - 1))) AS s FROM rows JOIN att USING (g, t) JOIN seen USING (g, t) JOIN share USING (tau) GROUP BY tau, cluster),
    z AS (SELECT b, tau, sum(({sign(11, 'cluster', 'b')}) * s) AS z FROM psi CROSS JOIN range({DRAWS}) r(b) GROUP BY b, tau),
    se AS (SELECT tau, stddev_samp(z) AS se FROM z GROUP BY tau),
    most AS (SELECT b, max(abs(z / se)) AS m FROM z JOIN se USING (tau) GROUP BY b),
    crit AS (SELECT m AS crit FROM (SELECT m, row_number() OVER (ORDER BY m) AS i FROM most) WHERE i = ceil(0.95 * {DRAWS + 1} - 1e-9)),
    est AS (SELECT tau, avg(att) AS e FROM att GROUP BY tau)
    SELECT CASE WHEN tau >= 0 THEN 'post' ELSE 'pre' END AS side, CAST(tau AS INT) AS tau, {rnd('e')} AS estimate, {rnd('se')} AS se, {rnd('e - crit * se', 5)} AS lower, {rnd('e + crit * se', 5)} AS upper
    FROM est JOIN se USING (tau) CROSS JOIN crit"""
SQL["es_reg"] = f"""WITH {_cells}, {_dy()}, fit AS (SELECT g, t, regr_slope(dy, x) AS s, regr_intercept(dy, x) AS i FROM rows WHERE d = 0 GROUP BY g, t)
    SELECT CAST(g AS BIGINT) AS g, CAST(t AS BIGINT) AS t, CAST(t - g AS INT) AS tau, {rnd('sum(d * (dy - s * x - i)) / sum(d) - sum((1 - d) * (dy - s * x - i)) / sum(1 - d)')} AS att, CAST(sum(d) AS BIGINT) AS n_treat
    FROM rows JOIN fit USING (g, t) GROUP BY g, t"""
_ddd = lambda seg, pre: f"{_dy(who=f'segment = {chr(39)}{seg}{chr(39)}', prefix=pre)}, {_att(pre)}, {pre}tau AS (SELECT tau, avg(att) AS att FROM {pre}att GROUP BY tau)"
SQL["ddd_tau"] = f"WITH {_cells}, {_ddd('AUTOMOBILE', 'a')}, {_ddd('BUILDING', 'b')} SELECT CAST(tau AS INT) AS tau, {rnd('atau.att - btau.att')} AS att FROM atau JOIN btau USING (tau)"

# trials
SQL["rct_ra"] = f"""WITH d AS ({RCT}), f AS (SELECT regr_slope(y, x) FILTER (WHERE arm = 1) AS s1, regr_intercept(y, x) FILTER (WHERE arm = 1) AS i1,
    regr_slope(y, x) FILTER (WHERE arm = 0) AS s0, regr_intercept(y, x) FILTER (WHERE arm = 0) AS i0 FROM d), g AS (SELECT arm, s1 * x + i1 - s0 * x - i0 AS gap FROM d CROSS JOIN f)
    SELECT 'RA_ATE__1_vs_0' AS param, {rnd('avg(gap)')} AS estimate FROM g UNION ALL SELECT 'RA_ATT__1_vs_0', {rnd('avg(gap)')} FROM g WHERE arm = 1
    UNION ALL SELECT 'RA_ATC__1_vs_0', {rnd('avg(gap)')} FROM g WHERE arm = 0"""
_ipw = lambda t, w1, w0: f"""WITH d AS (SELECT *, avg(arm) OVER (PARTITION BY stratum) AS p FROM ({RCT})), w AS (SELECT y, {w1} AS w1, {w0} AS w0 FROM d)
    SELECT 'IPW_{t}__1_vs_0' AS param, {rnd('sum(w1 * y) / sum(w1) - sum(w0 * y) / sum(w0)')} AS estimate FROM w"""  # noqa: E731
SQL["rct_ipw_ate"] = _ipw("ATE", "arm / p", "(1 - arm) / (1 - p)")
SQL["rct_ipw_att"] = _ipw("ATT", "CAST(arm AS DOUBLE)", "(1 - arm) * p / (1 - p)")
SQL["rct_ipw_atc"] = _ipw("ATC", "arm * (1 - p) / p", "CAST(1 - arm AS DOUBLE)")
SQL["rct_by_stratum"] = f"""SELECT 'IPW_ATE__1_vs_0_S' || CAST(row_number() OVER (ORDER BY stratum) AS VARCHAR) AS param, {rnd('avg(y) FILTER (WHERE arm = 1) - avg(y) FILTER (WHERE arm = 0)')} AS estimate
    FROM ({RCT}) GROUP BY stratum"""
SQL["rct_overlap"] = f"SELECT stratum, count(*) AS n FROM ({RCT}) GROUP BY stratum HAVING max(arm) = 1 AND min(arm) = 0"
_smd = lambda c: f"""SELECT '{c}' AS covariate, {rnd(f'avg({c}) FILTER (WHERE arm = 1)')} AS mean1, {rnd(f'avg({c}) FILTER (WHERE arm = 0)')} AS mean0,
    {rnd(f'(avg({c}) FILTER (WHERE arm = 1) - avg({c}) FILTER (WHERE arm = 0)) / sqrt((var_pop({c}) FILTER (WHERE arm = 1) + var_pop({c}) FILTER (WHERE arm = 0)) / 2)')} AS smd FROM d"""  # noqa: E731
SQL["balance_smd"] = f"WITH d AS ({RCT}) {_smd('y')} UNION ALL {_smd('x')}"

# graphs
_g = f"WITH n AS ({NATIONS}), e AS ({EDGES})"
SQL["slag_row"] = f"{_g} SELECT n.id, {rnd('coalesce(l.lag, 0)')} AS lag FROM n LEFT JOIN (SELECT src, sum(w * x) AS lag FROM e JOIN n ON n.id = dst GROUP BY src) l ON l.src = n.id"
SQL["slag_raw"] = f"{_g} SELECT n.id, {rnd('coalesce(l.lag, 0)')} AS lag FROM n LEFT JOIN (SELECT src, sum(x) AS lag FROM e JOIN n ON n.id = dst GROUP BY src) l ON l.src = n.id"
SQL["moran"] = f"""{_g}, s AS (SELECT sum(w) AS s0 FROM e), c AS (SELECT sum(w * a.x * b.x) AS ewe FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst),
    v AS (SELECT count(*) AS n, sum(x * x) AS ee FROM n) SELECT {rnd('n / s0 * ewe / ee')} AS moran, n FROM s CROSS JOIN c CROSS JOIN v"""
SQL["moran_panel"] = f"""WITH p AS (SELECT cluster AS id, t, avg(y) AS y FROM ({PANEL}) GROUP BY cluster, t), e AS ({EDGES}), s AS (SELECT sum(w) * (SELECT count(DISTINCT t) FROM p) AS s0 FROM e),
    c AS (SELECT sum(w * a.y * b.y) AS ewe FROM e JOIN p a ON a.id = src JOIN p b ON b.id = dst AND b.t = a.t), v AS (SELECT count(*) AS n, sum(y * y) AS ee FROM p)
    SELECT {rnd('n / s0 * ewe / ee')} AS moran, n FROM s CROSS JOIN c CROSS JOIN v"""
SQL["sar_instruments"] = f"""{_g}, w AS (SELECT n.id, coalesce(l.lag, 0) AS wx FROM n LEFT JOIN (SELECT src, sum(w * x) AS lag FROM e JOIN n ON n.id = dst GROUP BY src) l ON l.src = n.id)
    SELECT w.id, {rnd('w.wx')} AS wx, {rnd('coalesce(l.lag, 0)')} AS wwx FROM w LEFT JOIN (SELECT src, sum(e.w * o.wx) AS lag FROM e JOIN w o ON o.id = dst GROUP BY src) l ON l.src = w.id"""
SQL["radius_components"] = """WITH RECURSIVE s AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier),
    e AS (SELECT a.id AS u, b.id AS v FROM s a JOIN s b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0),
    reach(u, v) AS (SELECT id, id FROM s UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v) SELECT u AS id, min(v) AS component FROM reach GROUP BY u"""
SQL["exposure"] = f"""SELECT CAST(1996 + dst % 5 AS BIGINT) AS cg, src AS unit, {rnd('sum(w)')} AS exposure FROM ({EDGES}) WHERE dst % 5 > 0 GROUP BY 1, 2"""

# generalised least squares
SQL["gls_wls"] = ols(LINES, "y", ["d", "x", "1.0"], ["d", "x", "_cons"], "q")
_pw, _ = linear_system("moved", ["x", "k"], ["y"])
SQL["gls_pw_twostep"] = f"""WITH m AS ({MONTHLY}), f AS (SELECT regr_slope(y, x) AS sl, regr_intercept(y, x) AS ic FROM m),
    r AS (SELECT m.*, y - sl * x - ic AS u FROM m CROSS JOIN f), l AS (SELECT a.*, b.u AS pu, b.x AS px, b.y AS py FROM r a LEFT JOIN r b ON b.s = a.s AND b.t = a.t - 1),
    o AS (SELECT 1 - sum((u - pu) * (u - pu)) / sum(u * u) / 2 AS rho FROM l),
    moved AS (SELECT CASE WHEN pu IS NULL THEN sqrt(1 - rho * rho) * x ELSE x - rho * px END AS x, CASE WHEN pu IS NULL THEN sqrt(1 - rho * rho) ELSE 1 - rho END AS k,
        CASE WHEN pu IS NULL THEN sqrt(1 - rho * rho) * y ELSE y - rho * py END AS y FROM l CROSS JOIN o), {_pw}
    {rows([('x', 'b0_0'), ('_cons', 'b1_0')])} UNION ALL SELECT 'rho', {rnd('rho')} FROM o"""
SQL["gls_exch_rho"] = f"""WITH p AS ({PANEL}), f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p), r AS (SELECT id, y - s * x - i AS u FROM p CROSS JOIN f),
    c AS (SELECT id, sum(u) AS su, sum(u * u) AS q, count(*) AS m FROM r GROUP BY id) SELECT {rnd('sum(su * su - q) / sum((m - 1) * q)')} AS rho FROM c"""

# scalar functions
SQL["hac_kernels"] = """WITH d AS (SELECT i / 20.0 AS x, 6 * pi() * (i / 20.0) / 5 AS z FROM range(31) r(i))
    SELECT CAST(x AS DOUBLE) AS x, round(greatest(0.0, 1 - x), 8) + 0.0 AS bartlett, round(CASE WHEN x <= 0.5 THEN 1 - 6 * x * x + 6 * x * x * x WHEN x <= 1 THEN 2 * pow(1 - x, 3) ELSE 0.0 END, 8) + 0.0 AS parzen,
    round(CASE WHEN x < 1e-8 THEN 1.0 ELSE 3 / (z * z) * (sin(z) / z - cos(z)) END, 8) + 0.0 AS qs FROM d"""
SQL["haversine"] = """WITH n AS (SELECT n_nationkey AS k, radians(n_nationkey * 14.0 - 170) AS lon, radians(n_nationkey * 7.0 - 85) AS lat FROM nation)
    SELECT a.k, round(2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin((b.lat - a.lat) / 2), 2) + cos(a.lat) * cos(b.lat) * pow(sin((b.lon - a.lon) / 2), 2))))), 4) + 0.0 AS km FROM n a JOIN n b ON b.k = a.k - 1"""
SQL["bandwidths"] = """WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders) SELECT 'nw94' AS method, floor(4 * pow(n / 100, 2.0 / 9)) AS bandwidth FROM n
    UNION ALL SELECT 'qs', round(1.3221 * pow(n, 0.2), 6) FROM n UNION ALL SELECT 'bartlett', round(1.1447 * pow(n, 1.0 / 3), 6) FROM n UNION ALL SELECT 'parzen', round(2.6614 * pow(n, 0.2), 6) FROM n"""
SQL["multiplier_draws"] = f"SELECT b, CAST(sum({sign(5, 's_suppkey', 'b')}) AS DOUBLE) AS total FROM supplier CROSS JOIN range(10) r(b) GROUP BY b"

# dependence in time and space
SQL["time_kernel"] = f"""WITH r AS (SELECT t, row_number() OVER (ORDER BY t) AS r FROM (SELECT DISTINCT t FROM ({PANEL})))
    SELECT a.t AS s, b.t AS t, {rnd('1 - abs(a.r - b.r) / 3.0')} AS k FROM r a JOIN r b ON abs(a.r - b.r) < 3"""
_places = "p AS (SELECT s_suppkey AS id, s_acctbal / 100 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)"
SQL["space_kernel"] = f"""WITH {_places}, d AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a CROSS JOIN p b)
    SELECT a, b, {rnd('1 - d / 5.0')} AS k FROM d WHERE d < 5.0"""
SQL["space_cluster_multipliers"] = f"""WITH RECURSIVE {_places}, e AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0),
    reach(u, v) AS (SELECT id, id FROM p UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v), c AS (SELECT u, min(v) AS component FROM reach GROUP BY u)
    SELECT b, CAST(sum({sign(6, 'component', 'b')}) AS DOUBLE) AS total FROM c CROSS JOIN range(10) r(b) GROUP BY b"""


# signs by a row's place: the mix of row and draw in 64-bit arithmetic
_GOLD, _WRAP = 0x9E3779B97F4A7C15, 1 << 64


def _mixed(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % _WRAP
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % _WRAP
    return x ^ (x >> 31)


_steps = ", ".join(f"({b}, CAST({_mixed(((b + 1) * _GOLD + 4 * _GOLD + 0x632BE59BD9B4E019) % _WRAP)} AS UBIGINT))" for b in range(DRAWS))
_half = lambda x, shift, factor: f"CAST(CAST(xor({x}, {x} >> {shift}) AS UHUGEINT) * CAST({factor} AS UHUGEINT) % CAST({_WRAP} AS UHUGEINT) AS UBIGINT)"
_c, _b = linear_system("dat", ["x", "1.0"], ["y"], units=True)
_dev = [" + ".join(f"{_b[1 + j][i]} * z{j}" for j in range(2)) for i in range(2)]
SQL["ols_row_boot_se"] = f"""WITH dat AS (SELECT row_number() OVER () - 1 AS i, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS y, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS x FROM lineitem), {_c},
    steps(b, step) AS (VALUES {_steps}),
    m0 AS (SELECT b, x, y - x * b0_0 - b1_0 AS u, CAST((CAST(i AS UHUGEINT) + CAST(step AS UHUGEINT)) % CAST({_WRAP} AS UHUGEINT) AS UBIGINT) AS h FROM dat CROSS JOIN solved CROSS JOIN steps),
    m1 AS (SELECT b, x, u, {_half('h', 30, 0xBF58476D1CE4E5B9)} AS h FROM m0), m2 AS (SELECT b, x, u, {_half('h', 27, 0x94D049BB133111EB)} AS h FROM m1),
    sums AS (SELECT b, sum(CASE WHEN xor(h, h >> 31) >> 63 = 1 THEN x * u ELSE -x * u END) AS z0, sum(CASE WHEN xor(h, h >> 31) >> 63 = 1 THEN u ELSE -u END) AS z1 FROM m2 GROUP BY b),
    se AS (SELECT {', '.join(f'stddev_samp({e}) AS e{i}' for i, e in enumerate(_dev))} FROM sums CROSS JOIN solved)
    {' UNION ALL '.join(f"SELECT '{n}' AS param, {rnd(f'b{i}_0')} AS estimate, {rnd(f'e{i}')} AS se FROM solved CROSS JOIN se" for i, n in enumerate(('x', '_cons')))}"""

# restrictions: Wald statistics of free draws, and draws with x = 0 imposed
_c, _b = linear_system("dat", X, ["y"], units=True)
_dev = [" + ".join(f"{_b[1 + j][i]} * z{j}" for j in range(4)) for i in range(4)]
_factor = "sqrt((n - 1.0) / (n - 4.0) * g / (g - 1.0))"
_drawn = f"""sums AS (SELECT b, {', '.join(f"sum(({sign(7, 'supp', 'b')}) * s{j}) AS z{j}" for j in range(4))} FROM scores CROSS JOIN range({DRAWS}) r(b) GROUP BY b),
    k AS (SELECT count(*) AS g FROM scores), devs AS (SELECT b, {', '.join(f'{_factor} * ({e}) AS e{i}' for i, e in enumerate(_dev))}, b1_0, b2_0, b2_0 AS gap FROM sums CROSS JOIN solved CROSS JOIN k)"""
SQL["wald_ols"] = f"""WITH {_scores}, {_drawn}, v AS (SELECT var_samp(e1) AS v11, var_samp(e2) AS v22, covar_samp(e1, e2) AS v12 FROM devs),
    t AS (SELECT (e1 * e1 * v22 - 2 * e1 * e2 * v12 + e2 * e2 * v11) / (v11 * v22 - v12 * v12) AS t FROM devs CROSS JOIN v),
    c AS (SELECT t AS crit FROM (SELECT t, row_number() OVER (ORDER BY t) AS i FROM t) WHERE i = ceil(0.95 * {DRAWS + 1} - 1e-9))
    SELECT {rnd('(b1_0 * b1_0 * v22 - 2 * b1_0 * b2_0 * v12 + b2_0 * b2_0 * v11) / (v11 * v22 - v12 * v12)', 4)} AS statistic, {rnd('crit', 4)} AS critical FROM solved CROSS JOIN v CROSS JOIN c"""
_r, _ = linear_system("dat", ["q", "d", "1.0"], ["y"], p="r_")
_ur = "(y - q * r.b0_0 - d * r.b1_0 - r.b2_0)"
_under = f"""WITH dat AS ({LINES}), {_c}, {_r}, scores AS (SELECT supp, sum(q * {_ur}) AS s0, sum(d * {_ur}) AS s1, sum(x * {_ur}) AS s2, sum({_ur}) AS s3 FROM dat CROSS JOIN r_solved r GROUP BY supp), {_drawn}"""
SQL["ols_null_boot_se"] = f"""{_under}, se AS (SELECT {', '.join(f'stddev_samp(e{i}) AS f{i}' for i in range(4))} FROM devs)
    {' UNION ALL '.join(f"SELECT '{n}' AS param, {rnd(f'f{i}')} AS se FROM se" for i, n in enumerate(NAMES))}"""
SQL["ols_null_wald"] = f"""{_under}, v AS (SELECT var_samp(e2) AS v FROM devs), c AS (SELECT t AS crit FROM (SELECT e2 * e2 / v AS t, row_number() OVER (ORDER BY e2 * e2 / v) AS i FROM devs CROSS JOIN v) WHERE i = ceil(0.95 * {DRAWS + 1} - 1e-9))
    SELECT 'wald' AS metric, {rnd('b2_0 * b2_0 / v', 4)} AS value FROM solved CROSS JOIN v UNION ALL SELECT 'wald_crit', {rnd('crit', 4)} FROM c"""

# GMM: moments as rows
_mom = " UNION ALL ".join(f"SELECT sum(({z}) * x) AS ax, sum(({z}) * w) AS aw, sum({z}) AS ac, sum(({z}) * y) AS r FROM dat" for z in Z)
_g, _ = linear_system("mom", ["ax", "aw", "ac"], ["r"])
SQL["gmm_identity"] = f"WITH dat AS ({IVSET}), mom AS ({_mom}), {_g} {rows([('x', 'b0_0'), ('w', 'b1_0'), ('_cons', 'b2_0')])}"
_XY = ["x", "w", "1.0", "y"]
_sx, _ = linear_system("res", [f"({z}) * e" for z in Z], [f"({v}) / e" for v in _XY], extra=tuple(f"sum(({z}) * ({v})) AS m_{i}_{j}" for i, z in enumerate(Z) for j, v in enumerate(_XY)), p="s_")
_dot3 = lambda i, j: " + ".join(f"m_{q}_{i} * b{q}_{j}" for q in range(4))
_last, _ = eliminated("SELECT " + ", ".join([*(f"{_dot3(i, j)} AS a0_{i}_{j}" for i in range(3) for j in range(i, 3)), *(f"{_dot3(i, 3)} AS r0_{i}_0" for i in range(3))]) + " FROM s_solved", 3, 1, "l_")
_2s = f"{_IV}, res AS (SELECT hat.*, {_e} AS e FROM hat CROSS JOIN two), {_sx}, {_last}"
SQL["gmm_2step"] = f"{_2s} {rows([('x', 'b0_0'), ('w', 'b1_0'), ('_cons', 'b2_0')], 'l_solved')}"
_wi, _ = linear_system("mom", ["ax", "aw", "ac"], ["r"], weight="wt")
SQL["gmm_user_weight"] = f"""WITH dat AS ({IVSET}), mom AS ({' UNION ALL '.join(f"SELECT sum(({z}) * x) AS ax, sum(({z}) * w) AS aw, sum({z}) AS ac, sum(({z}) * y) AS r, {i + 1}.0 AS wt FROM dat" for i, z in enumerate(Z))}), {_wi}
    {rows([('x', 'b0_0'), ('w', 'b1_0'), ('_cons', 'b2_0')])}"""

# strength of instruments, moments by cluster
_adj = "sqrt((n - 1.0) / (n - 3.0) * g / (g - 1.0))"
SQL["iv_rank"] = f"""{_IV}, mo AS (SELECT cluster, sum(z1 * {_e}) AS s1, sum(z2 * {_e}) AS s2 FROM hat CROSS JOIN two GROUP BY cluster),
    q AS (SELECT sum(z1 * x) AS a1, sum(z2 * x) AS a2, sum(x * x) AS xx, CAST(count(*) AS DOUBLE) AS n FROM dat),
    v AS (SELECT sum(s1 * s1) AS v11, sum(s1 * s2) AS v12, sum(s2 * s2) AS v22, CAST(count(*) AS DOUBLE) AS g FROM mo),
    t AS (SELECT n, (a1 * a1 * v22 - 2 * a1 * a2 * v12 + a2 * a2 * v11) / (v11 * v22 - v12 * v12) / {_adj} / xx AS kp FROM q CROSS JOIN v)
    SELECT 'kp_rk_lm' AS metric, {rnd('n * kp', 4)} AS value FROM t UNION ALL SELECT 'kp_rk_wald_f', {rnd('kp * (n - 2) / 2', 4)} FROM t"""
_po, _ = linear_system("dat", ["w", "1.0"], ["z1", "z2", "x"], p="o_")
SQL["iv_effective_f"] = f"""WITH dat AS ({IVSET}), {_po}, t AS (SELECT cluster, z1 - w * b0_0 - b1_0 AS z1, z2 - w * b0_1 - b1_1 AS z2, x - w * b0_2 - b1_2 AS x FROM dat CROSS JOIN o_solved),
    q AS (SELECT sum(z1 * z1) AS q11, sum(z1 * z2) AS q12, sum(z2 * z2) AS q22, sum(z1 * x) AS r1, sum(z2 * x) AS r2, CAST(count(*) AS DOUBLE) AS n FROM t),
    p AS (SELECT *, (r1 * q22 - r2 * q12) / (q11 * q22 - q12 * q12) AS p1, (r2 * q11 - r1 * q12) / (q11 * q22 - q12 * q12) AS p2 FROM q),
    m AS (SELECT cluster, sum(z1 * (x - z1 * p1 - z2 * p2)) AS s1, sum(z2 * (x - z1 * p1 - z2 * p2)) AS s2 FROM t CROSS JOIN p GROUP BY cluster),
    v AS (SELECT sum(s1 * s1) AS v11, sum(s1 * s2) AS v12, sum(s2 * s2) AS v22, CAST(count(*) AS DOUBLE) AS g FROM m)
    SELECT 'mop_effective_f' AS metric, {rnd(f'(p1 * r1 + p2 * r2) / ((q22 * v11 - 2 * q12 * v12 + q11 * v22) / (q11 * q22 - q12 * q12) * {_adj})', 4)} AS value FROM p CROSS JOIN v"""

# draws of two-stage least squares: the reduced form's residuals are turned by cluster
_rf, _rb = linear_system("dat", Z, ["x", "y"], units=True)
_res = lambda v, m: f"({v} - " + " - ".join(f"({z}) * b{i}_{m}" for i, z in enumerate(Z)) + ")"
_zx = lambda i, j: f"(r0_{i}_0 + f * d{i})" if j == 0 else f"a0_{min(i, j + 1)}_{max(i, j + 1)}"
_hz = lambda i, q: "(" + " + ".join(f"{_zx(t, i)} * {_rb[2 + t][q]}" for t in range(4)) + ")"
_per, _ = eliminated("SELECT b, " + ", ".join([*(" + ".join(f"{_hz(i, q)} * {_zx(q, j)}" for q in range(4)) + f" AS a0_{i}_{j}" for i in range(3) for j in range(i, 3)),
    *(" + ".join(f"{_hz(i, q)} * (r0_{q}_1 + f * h{q})" for q in range(4)) + f" AS r0_{i}_0" for i in range(3))]) + " FROM pre", 3, 1, "b_")
SQL["iv_cluster_boot_se"] = f"""{_IV.replace(_first, _rf)}, sc AS (SELECT cluster, {', '.join([*(f"sum(({z}) * {_res('x', 0)}) AS x{i}" for i, z in enumerate(Z)), *(f"sum(({z}) * {_res('y', 1)}) AS y{i}" for i, z in enumerate(Z))])} FROM dat CROSS JOIN solved GROUP BY cluster),
    dr AS (SELECT b, {', '.join([*(f"sum(({sign(3, 'cluster', 'b')}) * x{i}) AS d{i}" for i in range(4)), *(f"sum(({sign(3, 'cluster', 'b')}) * y{i}) AS h{i}" for i in range(4))])} FROM sc CROSS JOIN range({DRAWS}) r(b) GROUP BY b),
    k AS (SELECT CAST(count(*) AS DOUBLE) AS g FROM sc), pre AS (SELECT dr.*, solved.* EXCLUDE (n), sqrt((n - 1.0) / (n - 3.0) * g / (g - 1.0)) AS f FROM dr CROSS JOIN solved CROSS JOIN k), {_per},
    se AS (SELECT {', '.join(f'stddev_samp(b{i}_0) AS e{i}' for i in range(3))} FROM b_solved)
    {' UNION ALL '.join(f"SELECT '{n}' AS param, {rnd(f'b{i}_0', 5)} AS estimate, {rnd(f'e{i}', 4)} AS se FROM two CROSS JOIN se" for i, n in enumerate(('x', 'w', '_cons')))}"""

# autoregressive errors
_runs = f"""m AS ({MONTHLY}), f AS (SELECT regr_slope(y, x) AS sl, regr_intercept(y, x) AS ic FROM m), r AS (SELECT m.*, y - sl * x - ic AS u FROM m CROSS JOIN f),
    l AS (SELECT a.*, b.u AS pu, b.x AS px, b.y AS py, b.s IS NOT NULL AS ins FROM r a LEFT JOIN r b ON b.s = a.s AND b.t = a.t - 1)"""
_moved = lambda rho, y="y", py="py": f"""CASE WHEN NOT ins THEN sqrt(1 - {rho} * {rho}) * x ELSE x - {rho} * px END AS x, CASE WHEN NOT ins THEN sqrt(1 - {rho} * {rho}) ELSE 1 - {rho} END AS k,
    CASE WHEN NOT ins THEN sqrt(1 - {rho} * {rho}) * {y} ELSE {y} - {rho} * {py} END AS y"""  # noqa: E731
_ps, _ = linear_system("moved", ["x", "k"], ["y"])
SQL["gls_psar1"] = f"""WITH {_runs}, o AS (SELECT s, 1 - coalesce(sum((u - pu) * (u - pu)), 0) / sum(u * u) / 2 AS rho FROM l GROUP BY s),
    moved AS (SELECT {_moved('o.rho')} FROM l JOIN o USING (s)), {_ps} {rows([('x', 'b0_0'), ('_cons', 'b1_0')])}"""
_sq = {"a": "CASE WHEN ins THEN {0} * {1} ELSE {0} * {1} END", "b": "CASE WHEN ins THEN {0} * p{1} + p{0} * {1} ELSE 0 END", "c": "CASE WHEN ins THEN p{0} * p{1} ELSE -{0} * {1} END",
       "d": "CASE WHEN ins THEN ({0} - p{0}) * ({1} - p{1}) ELSE 0 END", "e": "{0} * {1}"}
_ab = ["x", "k", "y"]
_qs = ", ".join(f"sum({f.format(a, b)}) AS {m}_{a}{b}" for m, f in _sq.items() for i, a in enumerate(_ab) for b in _ab[i:])
_form = lambda m: f"({m}_yy - 2 * it.bx * {m}_xy - 2 * it.bk * {m}_ky + it.bx * it.bx * {m}_xx + 2 * it.bx * it.bk * {m}_xk + it.bk * it.bk * {m}_kk)"
_poly = lambda ab: f"(a_{ab} - nrho * b_{ab} + nrho * nrho * c_{ab})"
SQL["gls_pw_iterated"] = f"""WITH RECURSIVE m AS ({MONTHLY}), l AS (SELECT a.x, a.y, 1.0 AS k, b.x AS px, b.y AS py, CASE WHEN b.s IS NULL THEN NULL ELSE 1.0 END AS pk, b.s IS NOT NULL AS ins FROM m a LEFT JOIN m b ON b.s = a.s AND b.t = a.t - 1),
    q AS (SELECT {_qs} FROM l),
    it(i, rho, gap, bx, bk) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(9 AS DOUBLE), (e_xy * e_kk - e_ky * e_xk) / (e_xx * e_kk - e_xk * e_xk), (e_ky * e_xx - e_xy * e_xk) / (e_xx * e_kk - e_xk * e_xk) FROM q
        UNION ALL SELECT i + 1, nrho, abs(nrho - rho), ({_poly('xy')} * {_poly('kk')} - {_poly('ky')} * {_poly('xk')}) / ({_poly('xx')} * {_poly('kk')} - {_poly('xk')} * {_poly('xk')}),
            ({_poly('ky')} * {_poly('xx')} - {_poly('xy')} * {_poly('xk')}) / ({_poly('xx')} * {_poly('kk')} - {_poly('xk')} * {_poly('xk')})
        FROM (SELECT it.*, q.*, 1 - {_form('d')} / {_form('e')} / 2 AS nrho FROM it CROSS JOIN q WHERE it.gap >= 0.001 AND it.i < 100)),
    z AS (SELECT * FROM it WHERE gap < 0.001) SELECT 'x' AS param, {rnd('bx')} AS estimate FROM z UNION ALL SELECT '_cons', {rnd('bk')} FROM z UNION ALL SELECT 'rho', {rnd('rho')} FROM z"""
_turn = lambda v: f"(2 * ((b >> j::BIGINT) & 1) - 1) * {v}"
_bs, _ = linear_system("moved", ["x", "k"], ["y"], by="b")
SQL["gls_ar1_boot_se"] = f"""WITH {_runs}, o AS (SELECT 1 - sum((u - pu) * (u - pu)) / sum(u * u) / 2 AS rho FROM l), g0_moved AS (SELECT {_moved('rho')} FROM l CROSS JOIN o),
    {linear_system("g0_moved", ["x", "k"], ["y"], p="est_")[0]},
    res AS (SELECT l.s, l.x, l.px, l.ins, l.y - l.x * b0_0 - b1_0 AS e, l.py - l.px * b0_0 - b1_0 AS pe FROM l CROSS JOIN est_solved),
    j AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS j FROM (SELECT DISTINCT s FROM m)),
    dr AS (SELECT b, x, px, ins, {_turn('e')} AS e, {_turn('pe')} AS pe FROM res JOIN j USING (s) CROSS JOIN range(32) r(b)),
    lines AS (SELECT b, regr_slope(e, x) AS sl, regr_intercept(e, x) AS ic FROM dr GROUP BY b), rest AS (SELECT dr.*, e - sl * x - ic AS u, pe - sl * px - ic AS pu FROM dr JOIN lines USING (b)),
    rhos AS (SELECT b, 1 - sum(CASE WHEN ins THEN (u - pu) * (u - pu) END) / sum(u * u) / 2 AS rho FROM rest GROUP BY b),
    moved AS (SELECT b, {_moved('rho', 'e', 'pe')} FROM rest JOIN rhos USING (b)), {_bs},
    k AS (SELECT (SELECT count(*) FROM m) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM j) AS g), se AS (SELECT stddev_samp(b0_0) AS e0, stddev_samp(b1_0) AS e1 FROM solved)
    SELECT 'x' AS param, {rnd('sqrt((n - 1.0) / (n - 2.0) * g / (g - 1.0)) * e0')} AS se FROM se CROSS JOIN k UNION ALL SELECT '_cons', {rnd('sqrt((n - 1.0) / (n - 2.0) * g / (g - 1.0)) * e1')} FROM se CROSS JOIN k"""

# spatial autoregression: two-stage least squares with Wx and WWx
_lagged = lambda of, v, name, src: f"{name} AS (SELECT {of}.*, coalesce(l.lag, 0) AS {src} FROM {of} LEFT JOIN (SELECT src, sum(e.w * o.{v}) AS lag FROM e JOIN {of} o ON o.id = dst GROUP BY src) l ON l.src = {of}.id)"
_s1, _ = linear_system("dat", ["wx", "wwx", "x", "1.0"], ["wy"])
_s2, _ = linear_system("hat", ["yh", "x", "1.0"], ["y"], p="t_")
SQL["sar"] = f"""WITH n AS ({NATIONS}), e AS ({EDGES}), {_lagged('n', 'x', 'n1', 'wx')}, {_lagged('n1', 'wx', 'n2', 'wwx')}, {_lagged('n2', 'y', 'dat', 'wy')}, {_s1},
    hat AS (SELECT dat.*, wx * b0_0 + wwx * b1_0 + x * b2_0 + b3_0 AS yh FROM dat CROSS JOIN solved), {_s2} {rows([('rho', 'b0_0'), ('x', 'b1_0'), ('_cons', 'b2_0')], 't_solved', 4)}"""

# logits by Newton steps, per cell; weighting and doubly robust cells
_p = "1 / (1 + exp(-(nw.b0 + nw.b1 * rows.x)))"
_newton = f"""nw(i, g, t, b0, b1) AS (SELECT 0, g, t, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM (SELECT DISTINCT g, t FROM rows)
    UNION ALL SELECT i + 1, g, t, b0 + (s0 * h11 - s1 * h01) / (h00 * h11 - h01 * h01), b1 + (s1 * h00 - s0 * h01) / (h00 * h11 - h01 * h01) FROM
    (SELECT nw.i, nw.g, nw.t, nw.b0, nw.b1, sum(d - {_p}) AS s0, sum((d - {_p}) * rows.x) AS s1, sum({_p} * (1 - {_p})) AS h00, sum({_p} * (1 - {_p}) * rows.x) AS h01, sum({_p} * (1 - {_p}) * rows.x * rows.x) AS h11
     FROM nw JOIN rows ON rows.g = nw.g AND rows.t = nw.t WHERE nw.i < 12 GROUP BY 1, 2, 3, 4, 5)),
    fitted AS (SELECT rows.*, {_p} AS p FROM rows JOIN nw ON rows.g = nw.g AND rows.t = nw.t AND nw.i = 12)"""
_dyx = _dy().replace("p.cluster, p.x,", "p.cluster, q.x,")
_logit = f"WITH RECURSIVE {_cells}, {_dyx}, {_newton}"
SQL["es_ipw"] = f"""{_logit} SELECT CAST(g AS BIGINT) AS g, CAST(t AS BIGINT) AS t, CAST(t - g AS INT) AS tau, {rnd('sum(d * dy) / sum(d) - sum((1 - d) * p / (1 - p) * dy) / sum((1 - d) * p / (1 - p))')} AS att, CAST(sum(d) AS BIGINT) AS n_treat
    FROM fitted GROUP BY g, t"""
SQL["es_dr"] = f"""{_logit}, line AS (SELECT g, t, regr_slope(dy, x) AS sl, regr_intercept(dy, x) AS ic, count(*) AS c00, sum(x) AS c01, sum(x * x) AS c11 FROM rows WHERE d = 0 GROUP BY g, t),
    w AS (SELECT f.*, c00, c01, c11, dy - sl * x - ic AS r, (1 - d) * p / (1 - p) AS w0 FROM fitted f JOIN line USING (g, t)),
    s AS (SELECT g, t, t - g AS tau, count(*) AS n, count(DISTINCT cluster) AS k, sum(d) AS n1, sum(w0) AS sw, sum(d * r) / sum(d) AS m1, sum(w0 * r) / sum(w0) AS m0,
        sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11, sum(d * x) / sum(d) - sum(w0 * x) / sum(w0) AS o1 FROM w GROUP BY g, t),
    v AS (SELECT w.*, n, k, n1, sw, m1, m0, h00, h01, h11, o1, tau FROM w JOIN s USING (g, t)),
    mm AS (SELECT g, t, sum(w0 * (r - m0)) / any_value(sw) AS q0, sum(w0 * (r - m0) * x) / any_value(sw) AS q1 FROM v GROUP BY g, t),
    psi AS (SELECT v.g, v.t, tau, cluster, n, k, d * (r - m1) / n1 - w0 * (r - m0) / sw - (d - p) * ((q0 * h11 - q1 * h01) + (q1 * h00 - q0 * h01) * x) / (h00 * h11 - h01 * h01)
        - (1 - d) * r * (-o1 * c01 + o1 * c00 * x) / (c00 * c11 - c01 * c01) AS psi FROM v JOIN mm ON mm.g = v.g AND mm.t = v.t),
    sizes AS (SELECT g, count(DISTINCT id) AS u FROM p WHERE g > 0 GROUP BY g), share AS (SELECT s.g, s.t, s.tau, u * 1.0 / sum(u) OVER (PARTITION BY s.tau) AS sh, m1 - m0 AS att FROM s JOIN sizes USING (g)),
    ctr AS (SELECT g, t, avg(psi) AS mean FROM psi GROUP BY g, t),
    term AS (SELECT psi.tau, cluster, sum((psi - mean) * sh * sqrt((n - 1.0) / (n - 2.0) * k / (k - 1.0))) AS s FROM psi JOIN ctr ON ctr.g = psi.g AND ctr.t = psi.t JOIN share ON share.g = psi.g AND share.t = psi.t GROUP BY psi.tau, cluster),
    z AS (SELECT b, tau, sum(({sign(0, 'cluster', 'b')}) * s) AS z FROM term CROSS JOIN range({DRAWS}) r(b) GROUP BY b, tau), se AS (SELECT tau, stddev_samp(z) AS se FROM z GROUP BY tau),
    most AS (SELECT b, max(abs(z / se)) AS m FROM z JOIN se USING (tau) GROUP BY b), crit AS (SELECT m AS crit FROM (SELECT m, row_number() OVER (ORDER BY m) AS i FROM most) WHERE i = ceil(0.95 * {DRAWS + 1} - 1e-9)),
    est AS (SELECT tau, sum(sh * att) AS e FROM share GROUP BY tau)
    SELECT CASE WHEN tau >= 0 THEN 'post' ELSE 'pre' END AS side, CAST(tau AS INT) AS tau, {rnd('e', 5)} AS estimate, {rnd('se', 5)} AS se, {rnd('e - crit * se', 4)} AS lower, {rnd('e + crit * se', 4)} AS upper FROM est JOIN se USING (tau) CROSS JOIN crit"""

# clustered trials
SQL["rct_cluster_se"] = f"""WITH d AS ({RCT}), a AS (SELECT avg(y) FILTER (WHERE arm = 1) AS m1, avg(y) FILTER (WHERE arm = 0) AS m0, sum(arm) AS n1, sum(1 - arm) AS n0 FROM d),
    s AS (SELECT nation, sum(CASE WHEN arm = 1 THEN (y - m1) / n1 ELSE -(y - m0) / n0 END) AS s FROM d CROSS JOIN a GROUP BY nation),
    z AS (SELECT b, sum(({sign(2, 'nation', 'b')}) * s) AS z FROM s CROSS JOIN range({DRAWS}) r(b) GROUP BY b), e AS (SELECT stddev_samp(z) AS se FROM z)
    SELECT param, {rnd('m1 - m0')} AS estimate, {rnd('se')} AS se FROM a CROSS JOIN e CROSS JOIN (VALUES ('RA_ATE__1_vs_0'), ('IPW_ATE__1_vs_0')) v(param)"""

# formulas
_f = lambda data, y, terms: ols(data, y, [*terms.values(), "1.0"], [*terms, "_cons"])
SQL["formula_factor"] = _f(LINES, "y", {"q": "q", "flag[N]": "CASE WHEN flag = 'N' THEN 1.0 ELSE 0.0 END", "flag[A]": "CASE WHEN flag = 'A' THEN 1.0 ELSE 0.0 END"})
SQL["formula_product"] = _f(LINES, "y", {"q": "q", "d": "d", "q:d": "q * d", "status[O]": "CASE WHEN status = 'O' THEN 1.0 ELSE 0.0 END"})
SQL["formula_transform"] = _f(LINES, "ln(y)", {"np.log(q)": "ln(q)", "I(d ** 2)": "d * d", "I((x > 0.3) * d)": "CASE WHEN x > 0.3 THEN d ELSE 0 END"})
SQL["formula_constraint"] = SQL["ols_constrained"]
SQL["formula_iv"] = SQL["iv_2sls"]
SQL["formula_fe"] = SQL["fe_oneway"]
SQL["formula_lag"] = f"WITH g AS ({GAPPY}), d AS (SELECT a.v, b.v AS l FROM g a JOIN g b ON b.id = a.id AND b.t = a.t - 1), {linear_system('d', ['l', '1.0'], ['v'])[0]} {rows([('__L__:v', 'b0_0'), ('_cons', 'b1_0')])}"

SQL["moran_permutation"] = f"""WITH n AS ({NATIONS}), e AS ({EDGES}), o AS (SELECT id, x, row_number() OVER (ORDER BY id) AS r FROM n),
    d AS (SELECT b, id, row_number() OVER (PARTITION BY b ORDER BY md5(concat('0:', CAST(b AS VARCHAR), ':', CAST(id AS VARCHAR)))) AS r FROM n CROSS JOIN range(199) q(b)),
    v AS (SELECT d.b, d.id, o.x FROM d JOIN o USING (r)), s AS (SELECT (SELECT sum(w) FROM e) AS s0, count(*) AS n, sum(x * x) AS ee FROM n),
    t AS (SELECT v.b, sum(w * v.x * u.x) * any_value(n / s0 / ee) AS i FROM e JOIN v ON v.id = src JOIN v u ON u.id = dst AND u.b = v.b CROSS JOIN s GROUP BY v.b),
    r AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM t), own AS (SELECT sum(w * a.x * c.x) * any_value(n / s0 / ee) AS i FROM e JOIN n a ON a.id = src JOIN n c ON c.id = dst CROSS JOIN s)
    SELECT {rnd('own.i')} AS moran, {rnd('(SELECT i FROM r WHERE k = 5)')} AS lower, {rnd('(SELECT i FROM r WHERE k = 195)')} AS upper FROM own"""

# Anderson-Rubin: do the instruments explain the outcome?  Draws of their coefficients, residuals without them.
_ar, _ab2 = linear_system("dat", Z, ["y"], units=True)
_pi = [" + ".join(f"{_ab2[1 + j][i]} * m{j}" for j in range(4)) for i in range(2)]
SQL["anderson_rubin"] = f"""WITH dat AS ({IVSET}), {_ar}, l AS (SELECT regr_slope(y, w) AS sl, regr_intercept(y, w) AS ic FROM dat),
    sc AS (SELECT cluster, {', '.join(f'sum(({z}) * (y - sl * w - ic)) AS s{i}' for i, z in enumerate(Z))} FROM dat CROSS JOIN l GROUP BY cluster),
    dr AS (SELECT b, {', '.join(f"sum(({sign(0, 'cluster', 'b')}) * s{i}) AS m{i}" for i in range(4))} FROM sc CROSS JOIN range({DRAWS}) r(b) GROUP BY b),
    p AS (SELECT {', '.join(f'{e} AS p{i}' for i, e in enumerate(_pi))} FROM dr CROSS JOIN solved), v AS (SELECT var_samp(p0) AS v11, var_samp(p1) AS v22, covar_samp(p0, p1) AS v12 FROM p),
    t AS (SELECT (p0 * p0 * v22 - 2 * p0 * p1 * v12 + p1 * p1 * v11) / (v11 * v22 - v12 * v12) AS t FROM p CROSS JOIN v),
    c AS (SELECT t AS crit FROM (SELECT t, row_number() OVER (ORDER BY t) AS i FROM t) WHERE i = ceil(0.95 * {DRAWS + 1} - 1e-9)),
    st AS (SELECT (b0_0 * b0_0 * v22 - 2 * b0_0 * b1_0 * v12 + b1_0 * b1_0 * v11) / (v11 * v22 - v12 * v12) AS stat FROM solved CROSS JOIN v)
    SELECT {rnd('stat', 4)} AS statistic, {rnd('crit', 4)} AS critical, stat > crit AS reject FROM st CROSS JOIN c"""

# Cross-fitted doubly robust cells: three folds by the hash of the unit; every fold's fits use the other two.
_fold = "CAST(floor(CAST(('0x' || substr(md5(concat('0:', CAST(id AS VARCHAR), ':fold')), 1, 12)) AS BIGINT) / 281474976710656.0 * 3) AS BIGINT)"
_pf = "1 / (1 + exp(-(nw.b0 + nw.b1 * rf.x)))"
SQL["dr_cross_fitted"] = f"""WITH RECURSIVE {_cells}, {_dyx}, rf AS (SELECT *, {_fold} AS fold FROM rows), folds(f) AS (VALUES (0), (1), (2)),
    fits AS (SELECT g, t, f, regr_slope(dy, x) FILTER (WHERE d = 1) AS s1, regr_intercept(dy, x) FILTER (WHERE d = 1) AS i1, regr_slope(dy, x) FILTER (WHERE d = 0) AS s0, regr_intercept(dy, x) FILTER (WHERE d = 0) AS i0
        FROM rf JOIN folds ON f <> fold GROUP BY g, t, f),
    nw(i, g, t, f, b0, b1) AS (SELECT 0, g, t, f, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM fits
        UNION ALL SELECT i + 1, g, t, f, b0 + (s0 * h11 - s1 * h01) / (h00 * h11 - h01 * h01), b1 + (s1 * h00 - s0 * h01) / (h00 * h11 - h01 * h01) FROM
        (SELECT nw.i, nw.g, nw.t, nw.f, nw.b0, nw.b1, sum(d - {_pf}) AS s0, sum((d - {_pf}) * rf.x) AS s1, sum({_pf} * (1 - {_pf})) AS h00, sum({_pf} * (1 - {_pf}) * rf.x) AS h01, sum({_pf} * (1 - {_pf}) * rf.x * rf.x) AS h11
         FROM nw JOIN rf ON rf.g = nw.g AND rf.t = nw.t AND rf.fold <> nw.f WHERE nw.i < 12 GROUP BY 1, 2, 3, 4, 5, 6)),
    own AS (SELECT rf.g, rf.t, rf.d, rf.dy, fits.s1 * rf.x + fits.i1 AS m1, fits.s0 * rf.x + fits.i0 AS m0, {_pf} AS p FROM rf JOIN fits ON fits.g = rf.g AND fits.t = rf.t AND fits.f = rf.fold
        JOIN nw ON nw.g = rf.g AND nw.t = rf.t AND nw.f = rf.fold AND nw.i = 12)
    SELECT CAST(g AS BIGINT) AS g, CAST(t AS BIGINT) AS t, CAST(t - g AS INT) AS tau, {rnd('sum(d * (m1 - m0)) / sum(d) + sum(d * (dy - m1)) / sum(d) - sum((1 - d) * p / (1 - p) * (dy - m0)) / sum((1 - d) * p / (1 - p))')} AS att,
        CAST(sum(d) AS BIGINT) AS n_treat FROM own GROUP BY g, t"""

# full precision matrix: the products of pairs of rows
_fw, _ = eliminated("SELECT " + ", ".join(["sum(w * p.x * q.x) AS a0_0_0", "sum(w * p.x) AS a0_0_1", "sum(w) AS a0_1_1", "sum(w * (p.x * q.y + q.x * p.y)) / 2 AS r0_0_0", "sum(w * (p.y + q.y)) / 2 AS r0_1_0"])
    + " FROM pr JOIN n p ON p.id = a JOIN n q ON q.id = b", 2, 1)
SQL["gls_full"] = f"""WITH n AS ({NATIONS}), e AS ({EDGES}), pr AS (SELECT src AS a, dst AS b, -0.5 * w AS w FROM e UNION ALL SELECT id, id, 1.0 FROM n), {_fw} {rows([('x', 'b0_0'), ('_cons', 'b1_0')])}"""
_five = [f"CASE WHEN k = {i} THEN 1.0 ELSE 0.0 END" for i in range(1, 5)]
_sd, _b = linear_system("d", ["arm", *_five, "1.0"], ["y"])
SQL["rct_strata_dummies"] = f"""WITH f AS (SELECT stratum, row_number() OVER (ORDER BY min(id)) - 1 AS k FROM ({RCT}) GROUP BY stratum), d AS (SELECT r.*, k FROM ({RCT}) r JOIN f USING (stratum)), {_sd}
    {rows(list(zip(['arm', *(f'stratum_{i}' for i in range(1, 5)), '_cons'], _b[0])))}"""
SQL["rct_trim_drop"] = f"""WITH d AS (SELECT *, avg(arm) OVER (PARTITION BY stratum) AS p FROM ({RCT})), w AS (SELECT y, arm / p AS w1, (1 - arm) / (1 - p) AS w0 FROM d WHERE p BETWEEN 0.45 AND 0.55)
    SELECT 'IPW_ATE__1_vs_0' AS param, {rnd('sum(w1 * y) / sum(w1) - sum(w0 * y) / sum(w0)')} AS estimate FROM w"""
SQL["es_common_taus"] = f"""{_ES}, c AS (SELECT tau FROM att GROUP BY tau HAVING count(DISTINCT g) = (SELECT count(DISTINCT g) FROM att)) SELECT CAST(tau AS INT) AS tau, {rnd('avg(att)')} AS att FROM att JOIN c USING (tau) GROUP BY tau"""
SQL["es_given_propensity"] = f"""WITH {_cells}, {_dy()}, w AS (SELECT *, 0.3 + cluster / 100 AS pi FROM rows)
    SELECT CAST(g AS BIGINT) AS g, CAST(t AS BIGINT) AS t, CAST(t - g AS INT) AS tau, {rnd('sum(d * dy) / sum(d) - sum((1 - d) * pi / (1 - pi) * dy) / sum((1 - d) * pi / (1 - pi))')} AS att, CAST(sum(d) AS BIGINT) AS n_treat FROM w GROUP BY g, t"""
SQL["fe_weightless"] = f"""WITH d AS (SELECT part, CASE WHEN flag = 'R' THEN d ELSE 0 END AS wt FROM ({LINES})), g AS (SELECT *, sum(wt) OVER (PARTITION BY part) AS s FROM d)
    SELECT count(*) FILTER (WHERE s > 0) AS kept, {rnd('sum(wt) FILTER (WHERE s > 0)', 4)} AS weight, count(*) FILTER (WHERE s = 0) AS dropped FROM g"""
SQL["duplicate_columns"] = f"""WITH d AS ({LINES}), s AS (SELECT bool_and(greatest(d, 0) = d) AS same FROM d) SELECT * FROM (VALUES ('q', false, false), ('d', false, false), ('again', true, false), ('flat', false, true)) v(name, duplicate, "constant")
    UNION ALL SELECT 'most', same, false FROM s"""
SQL["finite_mask"] = f"""WITH p AS ({GAPPY}) SELECT count(*) AS n, {rnd('sum(ln(a.v - 20))', 4)} AS total FROM p a JOIN p b ON b.id = a.id AND b.t = a.t - 1 WHERE a.v > 20 AND a.t <> 3"""
SQL["first_difference"] = f"SELECT id, t, v - lag(v) OVER (PARTITION BY id ORDER BY t) AS d_v FROM ({GAPPY})"
SQL["fe_missing_ids"] = f"SELECT count(*) FILTER (WHERE x < 4 AND y < 5) AS kept, count(*) FILTER (WHERE NOT (x < 4 AND y < 5)) AS dropped FROM ({ORDERED})"
SQL["kernel_density"] = """WITH d AS (SELECT s_acctbal / 1000 AS v FROM supplier), h AS (SELECT 0.9 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34) * pow(count(*), -0.2) AS h FROM d)
    SELECT round(avg(exp(-pow((v - 4) / h, 2) / 2) / sqrt(2 * pi())) / any_value(h), 8) + 0.0 AS density FROM d CROSS JOIN h"""
_ex, _ = linear_system("tr", ["tx", "tc"], ["ty"])
SQL["gls_exchangeable"] = f"""WITH p AS ({ORDERED}), f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p), r AS (SELECT id, y - s * x - i AS u FROM p CROSS JOIN f),
    c AS (SELECT id, sum(u) AS su, sum(u * u) AS q, count(*) AS m FROM r GROUP BY id), o AS (SELECT sum(su * su - q) / sum((m - 1) * q) AS rho FROM c),
    k AS (SELECT p.*, pow(1 - rho, -0.5) AS a, pow(1 - rho + rho * count(*) OVER (PARTITION BY id), -0.5) - pow(1 - rho, -0.5) AS b, avg(x) OVER (PARTITION BY id) AS mx, avg(y) OVER (PARTITION BY id) AS my FROM p CROSS JOIN o),
    tr AS (SELECT a * x + b * mx AS tx, a * y + b * my AS ty, a + b AS tc FROM k), {_ex} {rows([('x', 'b0_0'), ('_cons', 'b1_0')])}"""
_co, _ = linear_system("moved", ["x", "k"], ["y"])
SQL["gls_corc"] = f"""WITH {_runs}, o AS (SELECT 1 - sum((u - pu) * (u - pu)) / sum(u * u) / 2 AS rho FROM l), moved AS (SELECT x - rho * px AS x, 1 - rho AS k, y - rho * py AS y FROM l CROSS JOIN o WHERE ins), {_co}
    {rows([('x', 'b0_0'), ('_cons', 'b1_0')])}"""
_u12 = lambda at: f"(CAST(('0x' || substr(md5(concat('5:', CAST(s_suppkey AS VARCHAR), ':', CAST(b AS VARCHAR))), {at}, 12)) AS BIGINT) / 281474976710656.0)"
SQL["mammen_draws"] = f"""WITH d AS (SELECT b, {_u12(1)} AS u, {_u12(13)} AS v FROM supplier CROSS JOIN range(10) r(b))
    SELECT b, round(sum(CASE WHEN u < (sqrt(5) + 1) / (2 * sqrt(5)) THEN (1 - sqrt(5)) / 2 ELSE (1 + sqrt(5)) / 2 END), 8) + 0.0 AS mammen,
    round(sum([-sqrt(1.5), -1.0, -sqrt(0.5), sqrt(0.5), 1.0, sqrt(1.5)][CAST(floor(u * 6) AS INT) + 1]), 8) + 0.0 AS webb,
    round(sum(-ln(1 - u)), 8) + 0.0 AS exp, round(sum(sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v)), 8) + 0.0 AS normal FROM d GROUP BY b"""
SQL["fe_recovered"] = f"""WITH d AS ({LINES}), w AS (SELECT y - avg(y) OVER (PARTITION BY supp) AS y, q - avg(q) OVER (PARTITION BY supp) AS q FROM d WHERE supp IN (SELECT supp FROM d GROUP BY supp HAVING count(*) > 1)),
    s AS (SELECT sum(y * q) / sum(q * q) AS s FROM w) SELECT supp, {rnd('avg(y) - any_value(s) * avg(q)', 5)} AS effect FROM d CROSS JOIN s GROUP BY supp"""

# draws of errors with a rho for each unit, and of equally correlated ones: all rows, once for every draw
SQL["gls_psar1_boot_se"] = f"""WITH {_runs}, o AS (SELECT s, 1 - coalesce(sum((u - pu) * (u - pu)), 0) / sum(u * u) / 2 AS rho FROM l GROUP BY s), g0_moved AS (SELECT {_moved('o.rho')} FROM l JOIN o USING (s)),
    {linear_system("g0_moved", ["x", "k"], ["y"], p="est_")[0]},
    res AS (SELECT l.s, l.x, l.px, l.ins, l.y - l.x * b0_0 - b1_0 AS e, l.py - l.px * b0_0 - b1_0 AS pe FROM l CROSS JOIN est_solved),
    j AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS j FROM (SELECT DISTINCT s FROM m)),
    dr AS (SELECT b, s, x, px, ins, {_turn('e')} AS e, {_turn('pe')} AS pe FROM res JOIN j USING (s) CROSS JOIN range(32) r(b)),
    lines AS (SELECT b, regr_slope(e, x) AS sl, regr_intercept(e, x) AS ic FROM dr GROUP BY b), rest AS (SELECT dr.*, e - sl * x - ic AS u, pe - sl * px - ic AS pu FROM dr JOIN lines USING (b)),
    rhos AS (SELECT b, s, 1 - sum(CASE WHEN ins THEN (u - pu) * (u - pu) END) / sum(u * u) / 2 AS rho FROM rest GROUP BY b, s),
    moved AS (SELECT b, {_moved('rho', 'e', 'pe')} FROM rest JOIN rhos USING (b, s)), {_bs},
    k AS (SELECT (SELECT count(*) FROM m) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM j) AS g), se AS (SELECT stddev_samp(b0_0) AS e0, stddev_samp(b1_0) AS e1 FROM solved)
    SELECT 'x' AS param, {rnd('sqrt((n - 1.0) / (n - 2.0) * g / (g - 1.0)) * e0')} AS se FROM se CROSS JOIN k UNION ALL SELECT '_cons', {rnd('sqrt((n - 1.0) / (n - 2.0) * g / (g - 1.0)) * e1')} FROM se CROSS JOIN k"""
_exd, _ = linear_system("dtr", ["tx", "tc"], ["te"], by="b", p="d_")
SQL["gls_exch_boot_se"] = f"""{SQL["gls_exchangeable"].split("SELECT 'x' AS param")[0]},
    res AS (SELECT p.id, p.x, p.y - p.x * b0_0 - b1_0 AS e, count(*) OVER (PARTITION BY id) AS m FROM p CROSS JOIN solved),
    dr AS (SELECT b, id, x, m, ({sign(8, 'id', 'b')}) * e AS e FROM res CROSS JOIN range({DRAWS}) q(b)),
    ln AS (SELECT b, regr_slope(e, x) AS sl, regr_intercept(e, x) AS ic FROM dr GROUP BY b),
    cl AS (SELECT b, id, sum(e - sl * x - ic) AS su, sum((e - sl * x - ic) * (e - sl * x - ic)) AS q, any_value(m) AS m, avg(x) AS mx, avg(e) AS me FROM dr JOIN ln USING (b) GROUP BY b, id),
    rr AS (SELECT b, sum(su * su - q) / sum((m - 1) * q) AS rho FROM cl GROUP BY b),
    ab AS (SELECT b, id, mx, me, pow(1 - rho, -0.5) AS a, pow(1 - rho + rho * m, -0.5) - pow(1 - rho, -0.5) AS l FROM cl JOIN rr USING (b)),
    dtr AS (SELECT b, a * x + l * mx AS tx, a * e + l * me AS te, a + l AS tc FROM dr JOIN ab USING (b, id)), {_exd},
    kk AS (SELECT (SELECT count(*) FROM p) AS n, (SELECT CAST(count(DISTINCT id) AS DOUBLE) FROM p) AS g), se AS (SELECT stddev_samp(b0_0) AS e0, stddev_samp(b1_0) AS e1 FROM d_solved)
    SELECT 'x' AS param, {rnd('sqrt((n - 1.0) / (n - 2.0) * g / (g - 1.0)) * e0')} AS se FROM se CROSS JOIN kk UNION ALL SELECT '_cons', {rnd('sqrt((n - 1.0) / (n - 2.0) * g / (g - 1.0)) * e1')} FROM se CROSS JOIN kk"""

# spatial differences in differences: direct and spill paths, units' signs
_sp, _ = linear_system("r", ["1.0", "d", "s"], ["dy"], units=True, by="g, t", guard=True)
_lift = lambda i: f"(b{i}_1 + b{i}_2 * r.d + b{i}_3 * r.s)"
SQL["spatial_did"] = f"""WITH e AS ({EDGES}), p AS (SELECT cluster AS id, t, avg(y) AS y, CASE WHEN cluster IN (0, 5, 7) THEN 1998 WHEN cluster IN (1, 3) THEN 1999 ELSE 0 END AS g FROM ({PANEL}) GROUP BY cluster, t),
    c AS (SELECT DISTINCT a.g, b.t, a.g - 1 AS base FROM p a CROSS JOIN p b WHERE a.g > 0),
    x AS (SELECT c.g, c.t, p.id, CASE WHEN p.g = c.g THEN 1.0 ELSE 0.0 END AS d, p.y - q.y AS dy FROM c JOIN p ON p.t = c.t AND (p.g = c.g OR p.g = 0 OR p.g > greatest(c.t, c.base)) JOIN p q ON q.id = p.id AND q.t = c.base),
    ex AS (SELECT o.g, src AS id, sum(w) AS e FROM e JOIN (SELECT DISTINCT id, g FROM p WHERE g > 0) o ON o.id = dst GROUP BY o.g, src),
    y AS (SELECT x.*, CASE WHEN d = 1 THEN 0 ELSE coalesce(e, 0) END AS e FROM x LEFT JOIN ex ON ex.g = x.g AND ex.id = x.id),
    me AS (SELECT g, t, avg(e) AS me FROM y WHERE d = 0 GROUP BY g, t), r AS (SELECT y.*, CASE WHEN me > 0 THEN e / me ELSE 0 END AS s FROM y JOIN me USING (g, t)), {_sp},
    n AS (SELECT g, count(DISTINCT id) AS n FROM p WHERE g > 0 GROUP BY g), sh AS (SELECT solved.*, t - solved.g AS tau, n.n * 1.0 / sum(n.n) OVER (PARTITION BY t - solved.g) AS share FROM solved JOIN n ON n.g = solved.g),
    path AS (SELECT 'direct' AS side, tau, sum(share * b1_0) AS v FROM sh GROUP BY tau UNION ALL SELECT 'spill', tau, sum(share * b2_0) FROM sh GROUP BY tau),
    u AS (SELECT r.id, sh.tau, sh.share, r.dy - b0_0 - b1_0 * r.d - b2_0 * r.s AS u, {_lift(1)} AS l1, {_lift(2)} AS l2 FROM r JOIN sh ON sh.g = r.g AND sh.t = r.t),
    sc AS (SELECT 'direct' AS side, id, tau, sum(share * u * l1) AS z FROM u GROUP BY id, tau UNION ALL SELECT 'spill', id, tau, sum(share * u * l2) FROM u GROUP BY id, tau),
    dr AS (SELECT side, tau, b, sum(({sign(0, 'id', 'b')}) * z) AS z FROM sc CROSS JOIN range({DRAWS}) q(b) GROUP BY side, tau, b),
    mv AS (SELECT a.side, a.tau, a.b, a.z - o.z AS z FROM dr a JOIN dr o ON o.side = a.side AND o.b = a.b AND o.tau = -1), se AS (SELECT side, tau, stddev_samp(z) AS se FROM mv GROUP BY side, tau),
    ms AS (SELECT side, b, max(abs(z / se)) AS m FROM mv JOIN se USING (side, tau) WHERE se > 0 GROUP BY side, b),
    cr AS (SELECT side, m AS crit FROM (SELECT side, m, row_number() OVER (PARTITION BY side ORDER BY m) AS i FROM ms) WHERE i = ceil(0.95 * {DRAWS + 1} - 1e-9)),
    es AS (SELECT path.side, path.tau, path.v - o.v AS v FROM path JOIN path o ON o.side = path.side AND o.tau = -1)
    SELECT side, CAST(tau AS INT) AS tau, {rnd('v')} AS estimate, {rnd('se')} AS se, {rnd('v - coalesce(crit, 0) * se', 4)} AS lower, {rnd('v + coalesce(crit, 0) * se', 4)} AS upper FROM es JOIN se USING (side, tau) LEFT JOIN cr USING (side)"""

SQL["es_percentiles"] = SQL["es_supt_band"].split("    se AS (SELECT tau, stddev_samp(z)")[0].rstrip().rstrip(",") + f""", est AS (SELECT tau, avg(att) AS e FROM att GROUP BY tau),
    o AS (SELECT tau, z, row_number() OVER (PARTITION BY tau ORDER BY z) AS i FROM z)
    SELECT CAST(tau AS INT) AS tau, CAST(level AS DOUBLE) AS level, {rnd('e + z', 5)} AS value FROM o JOIN est USING (tau) CROSS JOIN (VALUES (0.05), (0.5), (0.95)) v(level) WHERE i = ceil(level * {DRAWS} - 1e-12)"""
_wm = lambda c, a: f"sum({c} * wt) FILTER (WHERE arm = {a}) / sum(wt) FILTER (WHERE arm = {a})"
_wv = lambda c, a: f"(sum({c} * {c} * wt) FILTER (WHERE arm = {a}) / sum(wt) FILTER (WHERE arm = {a}) - pow({_wm(c, a)}, 2))"
SQL["balance_plot"] = f"WITH d AS (SELECT *, avg(arm) OVER (PARTITION BY stratum) AS p FROM ({RCT})), w AS (SELECT y, x, arm, 'raw' AS sample, 1.0 AS wt FROM d UNION ALL SELECT y, x, arm, 'weighted', CASE WHEN arm = 1 THEN 1 / p ELSE 1 / (1 - p) END FROM d) " + " UNION ALL ".join(
    f"SELECT '{c}' AS covariate, sample, {rnd(f'({_wm(c, 1)} - {_wm(c, 0)}) / sqrt(({_wv(c, 1)} + {_wv(c, 0)}) / 2)')} AS smd FROM w GROUP BY sample" for c in ("y", "x"))

# clusters two ways, and six-point multipliers
def _clustered(by: str, weight: str, factor: str) -> str:
    c, b = linear_system("dat", X, ["y"], units=True)
    dev = [" + ".join(f"{b[1 + j][i]} * z{j}" for j in range(4)) for i in range(4)]
    return f"""WITH dat AS ({LINES}), {c}, scores AS (SELECT {by}, sum(q * {_u}) AS s0, sum(d * {_u}) AS s1, sum(x * {_u}) AS s2, sum({_u}) AS s3 FROM dat CROSS JOIN solved GROUP BY {by}),
    sums AS (SELECT b, {', '.join(f'sum({weight} * s{j}) AS z{j}' for j in range(4))} FROM scores CROSS JOIN range({DRAWS}) r(b) GROUP BY b),
    k AS (SELECT CAST({factor} AS DOUBLE) AS g FROM scores), se AS (SELECT {', '.join(f'stddev_samp({e}) AS e{i}' for i, e in enumerate(dev))} FROM sums CROSS JOIN solved),
    f AS (SELECT *, sqrt((n - 1.0) / (n - 4.0) * g / (g - 1.0)) AS c FROM solved CROSS JOIN k CROSS JOIN se)
    {' UNION ALL '.join(f"SELECT '{n}' AS param, {rnd(f'b{i}_0')} AS estimate, {rnd(f'c * e{i}')} AS se FROM f" for i, n in enumerate(NAMES))}"""


SQL["ols_twoway_boot_se"] = _clustered("supp, status", f"({sign(7, 'supp', 'b')}) * ({sign(8, 'status', 'b')})", "least(count(DISTINCT supp), count(DISTINCT status))")
SQL["ols_robust_webb_se"] = _clustered("supp", "[-sqrt(1.5), -1.0, -sqrt(0.5), sqrt(0.5), 1.0, sqrt(1.5)][CAST(floor(CAST(('0x' || substr(md5(concat('7:', CAST(supp AS VARCHAR), ':', CAST(b AS VARCHAR))), 1, 12)) AS BIGINT) / 281474976710656.0 * 6) AS INT) + 1]", "count(*)")
