"""The queries' DuckDB equivalents. Three assets are written out as the six entries of the upper triangle; the
reference's eigenvalues come from the cosine formula and its leading projector from the characteristic polynomial, so
no step is shared with the engine."""

from __future__ import annotations

ASSETS = ("A", "N", "R")
#: Entries: name, row, column, weight in sums over the whole matrix.
ENTRIES = [("c1", 0, 0, 1), ("c2", 0, 1, 2), ("c3", 0, 2, 2), ("c4", 1, 1, 1), ("c5", 1, 2, 2), ("c6", 2, 2, 1)]
NAMES = [e[0] for e in ENTRIES]
DIAGONAL = ("c1", "c4", "c6")
PLACE = {(i, j): n for n, i, j, _ in ENTRIES} | {(j, i): n for n, i, j, _ in ENTRIES}


def r(expression: str, name: str) -> str:
    return f"round({expression}, 8) + 0.0 AS {name}"


def _sum(prefix: str, names=NAMES, other: str | None = None) -> str:
    """Weighted sum of squares, or of products with another prefix."""
    weights = {n: w for n, _, _, w in ENTRIES}
    return " + ".join(f"{weights[n]} * {prefix}{n} * {other if other is not None else prefix}{n}" for n in names)


def _overall(prefix: str) -> str:
    return _sum(prefix)


def _diagonal(prefix: str) -> str:
    return _sum(prefix, DIAGONAL)


def _off(prefix: str) -> str:
    return _sum(prefix, [n for n in NAMES if n not in DIAGONAL])


def _product(i: int, j: int) -> str:
    """Entry (i, j) of (S0 - l2 I)(S0 - l3 I)."""
    terms = []
    for k in range(3):
        left = f"(s{PLACE[i, k]}{' - l2' if i == k else ''})"
        right = f"(s{PLACE[k, j]}{' - l3' if k == j else ''})"
        terms.append(f"{left} * {right}")
    return " + ".join(terms)


RAW = """raw AS (SELECT l_shipdate AS ts, l_returnflag AS asset, round(sum(l_extendedprice), 2) / sum(l_quantity) AS price FROM lineitem
  WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY ALL),
wide AS (SELECT ts, max(price) FILTER (asset = 'A') AS pa, max(price) FILTER (asset = 'N') AS pn, max(price) FILTER (asset = 'R') AS pr
  FROM raw GROUP BY ts HAVING count(*) = 3),
ret AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY ts) - 1 AS pos, ts, ln(pa) - lag(ln(pa)) OVER (ORDER BY ts) AS r0,
  ln(pn) - lag(ln(pn)) OVER (ORDER BY ts) AS r1, ln(pr) - lag(ln(pr)) OVER (ORDER BY ts) AS r2 FROM wide) WHERE pos >= 1)"""

BLOCKS = f"""{RAW},
blk AS (SELECT (pos - 1) // 10 AS k, max(ts) AS ts, {', '.join(f'covar_samp(r{i}, r{j}) AS {n}' for n, i, j, _ in ENTRIES)}
  FROM ret GROUP BY 1 HAVING count(*) = 10),
cnt AS (SELECT count(*) AS nmat, count(*) // 2 AS ntrain FROM blk)"""

REFERENCE = f"""{BLOCKS},
ref0 AS (SELECT {', '.join(f'avg({n}) AS s{n}' for n in NAMES)} FROM blk, cnt WHERE k < ntrain),
ref1 AS (SELECT *, (sc1 + sc4 + sc6) / 3 AS t FROM ref0),
ref2 AS (SELECT *, sqrt(((sc1 - t) ** 2 + (sc4 - t) ** 2 + (sc6 - t) ** 2 + 2 * (sc2 * sc2 + sc3 * sc3 + sc5 * sc5)) / 6) AS g FROM ref1),
ref3 AS (SELECT *, acos(greatest(-1.0, least(1.0, ((sc1 - t) * ((sc4 - t) * (sc6 - t) - sc5 * sc5) - sc2 * (sc2 * (sc6 - t) - sc5 * sc3)
  + sc3 * (sc2 * sc5 - (sc4 - t) * sc3)) / (2 * g * g * g)))) / 3 AS angle FROM ref2),
ref4 AS (SELECT *, t + 2 * g * cos(angle) AS l1, t + 2 * g * cos(angle + 2 * pi() / 3) AS l3 FROM ref3),
ref5 AS (SELECT *, 3 * t - l1 - l3 AS l2 FROM ref4),
ref AS (SELECT *, {', '.join(f'({_product(i, j)}) / ((l1 - l2) * (l1 - l3)) AS p{n}' for n, i, j, _ in ENTRIES)} FROM ref5)"""

INDICATOR = f"""{REFERENCE},
ind0 AS (SELECT k, ts, nmat, ntrain, l1, {', '.join(NAMES)}, {', '.join(f's{n}, p{n}' for n in NAMES)},
  {' + '.join(f'{w} * p{n} * {n}' for n, _, _, w in ENTRIES)} AS z FROM blk, cnt, ref),
ind AS (SELECT *, CASE WHEN k < ntrain THEN 'Training' ELSE 'Holdout' END AS sample,
  {', '.join(f'{n} - (s{n} + (z - l1) * p{n}) AS e{n}' for n in NAMES)} FROM ind0)"""

ERRORS = f"""{INDICATOR},
err AS (SELECT k, ts, sample, sqrt({_overall('e')}) AS norm_e, sqrt({_overall('')}) AS norm_s FROM ind)"""

FORECASTS = f"""{INDICATOR},
lagged AS (SELECT *, lag(z) OVER (ORDER BY k) AS z_hat, {', '.join(f'lag({n}) OVER (ORDER BY k) AS d{n}' for n in NAMES)} FROM ind),
held AS (SELECT *, {', '.join(f's{n} + (z_hat - l1) * p{n} AS n{n}' for n in NAMES)} FROM lagged WHERE k >= ntrain),
fc AS (SELECT 'direct_naive' AS method, k, ts, {', '.join(f'{n}, d{n} AS f{n}, {n} - d{n} AS x{n}' for n in NAMES)} FROM held
  UNION ALL SELECT 'naive_indicator', k, ts, {', '.join(f'{n}, n{n}, {n} - n{n}' for n in NAMES)} FROM held)"""

LOSSES = f"""{FORECASTS},
loss AS (SELECT method, k, ts, {_overall('x')} AS overall, {_diagonal('x')} AS diagonal, {_off('x')} AS off_diagonal FROM fc)"""

DIFFERENCES = f"""{LOSSES},
diff0 AS (SELECT k, ts, sum(overall) FILTER (method = 'direct_naive') - sum(overall) FILTER (method = 'naive_indicator') AS diff FROM loss GROUP BY ALL),
diff AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos, sum(diff) OVER (ORDER BY ts) AS cumulative FROM diff0)"""

SPECTRUM = f"""{INDICATOR},
zt AS (SELECT k AS pos, z AS value FROM ind WHERE k < ntrain),
zn AS (SELECT count(*) AS n, avg(value) AS mean FROM zt),
spec AS (SELECT j, 2 * pi() * j / n AS omega, (sum((value - mean) * cos(2 * pi() * j * pos / n)) ** 2 + sum((value - mean) * sin(2 * pi() * j * pos / n)) ** 2)
  / (2 * pi() * n) AS power FROM zt, zn, (SELECT unnest(range(1, 100000)) AS j) WHERE j <= (n - 1) // 2 GROUP BY j, n)"""

GRID = f"""{SPECTRUM},
grid AS (SELECT step / 1000.0::DOUBLE AS d, count(*) AS m, avg(power * exp(2 * (step / 1000.0::DOUBLE) * ln(2 * sin(omega / 2)))) AS level, sum(ln(2 * sin(omega / 2))) AS factors
  FROM spec, (SELECT unnest(range(-490, 491)) AS step) GROUP BY step),
obj AS (SELECT d, m, m * ln(2 * pi() * level) - 2 * d * factors AS objective, 2 * pi() * level AS innovation_variance FROM grid),
best AS (SELECT d, m, objective, innovation_variance FROM obj ORDER BY objective, d LIMIT 1)"""

COEFFICIENTS = f"""{INDICATOR},
coef AS (SELECT asset AS series, k, ts, ntrain, sample, value FROM ind, LATERAL (VALUES ('A', ec1), ('N', ec4), ('R', ec6)) AS v(asset, value))"""


def _fitted(x: str, source: str) -> str:
    """Fractional models of rows (series, k, value): grid values {x}o, their minimum {x}b, and {x}d with the d where the
    objective's derivative changes sign between the neighbours of the minimum."""
    return f"""{x}n AS (SELECT series, count(*) AS n, avg(value) AS mean FROM {source} GROUP BY series),
{x}p AS (SELECT series, j, 2 * ln(2 * sin(pi() * j / n)) AS x, (sum((value - mean) * cos(2 * pi() * j * k / n)) ** 2 + sum((value - mean) * sin(2 * pi() * j * k / n)) ** 2) / (2 * pi() * n) AS power
  FROM {source} JOIN {x}n USING (series), (SELECT unnest(range(1, 100000)) AS j) WHERE j <= (n - 1) // 2 GROUP BY series, j, n),
{x}o AS (SELECT series, step, count(*) * ln(2 * pi() * avg(power * exp(step / 1000.0::DOUBLE * x))) - step / 1000.0::DOUBLE * sum(x) AS q FROM {x}p, (SELECT unnest(range(-490, 491)) AS step) GROUP BY series, step),
{x}b AS (SELECT series, arg_min(step, (q, step)) AS step FROM {x}o GROUP BY series),
{x}l AS (SELECT series, list(power ORDER BY j) AS ps, list(x ORDER BY j) AS xs, sum(x) AS total, count(*) AS m FROM {x}p GROUP BY series),
{x}h AS (SELECT series, greatest(step - 1, -490) / 1000.0::DOUBLE AS low, least(step + 1, 490) / 1000.0::DOUBLE AS high, 0 AS i FROM {x}b
  UNION ALL SELECT series, CASE WHEN up THEN low ELSE mid END, CASE WHEN up THEN mid ELSE high END, i + 1 FROM (SELECT h.series, low, high, i, (low + high) / 2 AS mid,
    list_sum(list_transform(list_zip(ps, xs), lambda e: e[1] * exp((low + high) / 2 * e[2]) * (m * e[2] - total))) > 0 AS up FROM {x}h h JOIN {x}l l ON l.series = h.series WHERE i < 40)),
{x}f AS (SELECT series, (low + high) / 2 AS d FROM {x}h WHERE i = 40),
{x}d AS (SELECT series, d, step / 1000.0::DOUBLE AS grid_best_d, 2 * pi() * avg(power * exp(d * x)) AS variance, count(*) * ln(2 * pi() * avg(power * exp(d * x))) - d * sum(x) AS objective, count(*) AS m
  FROM {x}p JOIN {x}f USING (series) JOIN {x}b USING (series) GROUP BY series, d, step)"""


def _differenced(x: str, d: str) -> str:
    """Series of ser (and their means in fn) differenced by the d of a table: {x}v, and its forecasts {x}z."""
    return f"""{x}g AS (SELECT series, q, CASE WHEN q = 0 THEN 1.0 ELSE (q - 1 - d) / q END AS f FROM {d}, (SELECT unnest(range(0, 100000)) AS q), cnt WHERE q < nmat),
{x}w AS (SELECT series, q, exp(sum(ln(greatest(abs(f), 1e-300))) OVER (PARTITION BY series ORDER BY q)) * CASE WHEN sum(CASE WHEN f < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY q) % 2 = 0 THEN 1 ELSE -1 END AS weight FROM {x}g),
{x}v AS (SELECT a.series, a.k, max(a.value) AS value, max(a.ntrain) AS ntrain, sum(weight * (b.value - mean)) AS innovation
  FROM ser a JOIN ser b ON b.series = a.series AND b.k <= a.k JOIN {x}w w ON w.series = a.series AND w.q = a.k - b.k JOIN fn ON fn.series = a.series GROUP BY a.series, a.k),
{x}z AS (SELECT series, k, value, value - innovation AS z_hat FROM {x}v WHERE k >= ntrain)"""


#: Fractional models of the indicator and of every residual coefficient, each as a series of its own.
FRACTIONAL = f"""{COEFFICIENTS},
ser AS (SELECT 'z' AS series, k, z AS value, ntrain, nmat FROM ind UNION ALL SELECT series, k, value, ntrain, (SELECT nmat FROM cnt) FROM coef),
tr AS (SELECT series, k, value FROM ser WHERE k < ntrain),
{_fitted('f', 'tr')},
{_differenced('f', 'fd')}"""
ARFIMA = f"""{FRACTIONAL},
zh AS (SELECT k, z_hat FROM fz WHERE series = 'z')"""
#: At the grid's d.
ARFIMA_GRID = f"""{FRACTIONAL},
{_differenced('r', "(SELECT series, grid_best_d AS d FROM fd WHERE series = 'z')")},
zh AS (SELECT k, z_hat FROM rz)"""


def _arfima_rmse(source: str) -> str:
    return f"""WITH {source}, ax AS (SELECT k, {', '.join(f'{n} - (s{n} + (z_hat - l1) * p{n}) AS x{n}' for n in NAMES)} FROM zh JOIN ind USING (k)),
lg AS (SELECT *, lag(z) OVER (ORDER BY k) AS zb, {', '.join(f'lag({n}) OVER (ORDER BY k) AS d{n}' for n in NAMES)} FROM ind),
al AS (SELECT 'arfima_indicator' AS method, {', '.join('x' + n for n in NAMES)} FROM ax UNION ALL SELECT 'direct_naive', {', '.join(f'{n} - d{n}' for n in NAMES)} FROM lg WHERE k >= ntrain
UNION ALL SELECT 'naive_indicator', {', '.join(f'{n} - (s{n} + (zb - l1) * p{n})' for n in NAMES)} FROM lg WHERE k >= ntrain),
t AS (SELECT method, sqrt(sum({_overall('x')}) / (count(*) * 9)) AS overall, sqrt(sum({_diagonal('x')}) / (count(*) * 3)) AS diagonal, sqrt(sum({_off('x')}) / (count(*) * 6)) AS off_diagonal FROM al GROUP BY method)"""


_RMSE_ROWS = f"""SELECT method, {r('overall', 'overall')}, {r('diagonal', 'diagonal')}, {r('off_diagonal', 'off_diagonal')}, {r("(overall / (SELECT overall FROM t WHERE method = 'direct_naive') - 1) * 100", 'change_pct')} FROM t"""

ORDERS = 5


def _eliminated(x: str, p: int) -> str:
    """Least squares of order p on rows {x}g below every end of {x}e, by elimination of the covariances."""
    lags = range(1, p + 1)
    sums = [f"avg(y{i}) AS m{i}" for i in range(p + 1)] + [f"covar_pop(y{i}, y{j}) AS a{i}_{j}" for i in lags for j in lags] + [f"covar_pop(y0, y{i}) AS b{i}" for i in lags]
    parts = [f"{x}{p}_0 AS (SELECT series, until, {', '.join(sums)} FROM {x}g, {x}e WHERE k >= {p} AND k < until GROUP BY series, until)"]
    means = ", ".join(f"m{i}" for i in range(p + 1))
    for q in lags:
        a = [f"a{q}_{j} / a{q}_{q} AS a{q}_{j}" if i == q else f"a{i}_{j} - a{i}_{q} * a{q}_{j} / a{q}_{q} AS a{i}_{j}" for i in lags for j in lags]
        b = [f"b{q} / a{q}_{q} AS b{q}" if i == q else f"b{i} - a{i}_{q} * b{q} / a{q}_{q} AS b{i}" for i in lags]
        parts.append(f"{x}{p}_{q} AS (SELECT series, until, {means}, {', '.join(a + b)} FROM {x}{p}_{q - 1})")
    return ",\n".join(parts)


def _autoregressed(x: str, source: str, start: str, training: str) -> str:
    """Autoregressions of rows (series, k, value): fits {x}r below the validation's start and the training's end,
    validation errors {x}v, stationarity {x}s, forecasts {x}z by the selected order."""
    fits = []
    for p in range(1, ORDERS + 1):
        f = [f"b{i} AS f{i}" if i <= p else f"0.0::DOUBLE AS f{i}" for i in range(1, ORDERS + 1)]
        fits.append(f"SELECT series, until, {p} AS ord, m0{''.join(f' - b{i} * m{i}' for i in range(1, p + 1))} AS icept, {', '.join(f)} FROM {x}{p}_{p}")
    made = "icept" + "".join(f" + CASE WHEN ord >= {i} THEN f{i} * y{i} ELSE 0 END" for i in range(1, ORDERS + 1))
    down = [f"{x}s{ORDERS} AS (SELECT series, ord, true AS fine, {', '.join(f'f{i}' for i in range(1, ORDERS + 1))} FROM {x}r WHERE until = {start})"]
    for q in range(ORDERS, 0, -1):
        a = "".join(f", CASE WHEN abs(f{q}) < 1 THEN (f{i} + f{q} * f{q - i}) / (1 - f{q} * f{q}) ELSE 0 END AS f{i}" for i in range(1, q))
        down.append(f"{x}s{q - 1} AS (SELECT series, ord, fine AND abs(f{q}) < 1 AS fine{a} FROM {x}s{q})")
    newline = ",\n"
    return f"""{x}g AS (SELECT series, k, value AS y0, {', '.join(f'lag(value, {i}) OVER (PARTITION BY series ORDER BY k) AS y{i}' for i in range(1, ORDERS + 1))} FROM {source}),
{x}e AS (SELECT DISTINCT unnest([{start}, {training}]) AS until),
{newline.join(_eliminated(x, p) for p in range(1, ORDERS + 1))},
{x}r AS ({' UNION ALL '.join(fits)}),
{x}v AS (SELECT series, ord, sqrt(avg(({made} - y0) ** 2)) AS rmse FROM {x}g JOIN {x}r USING (series) WHERE until = {start} AND k >= {start} AND k < {training} GROUP BY series, ord),
{x}b AS (SELECT series, arg_min(ord, (rmse, ord)) AS ord FROM {x}v GROUP BY series),
{newline.join(down)},
{x}z AS (SELECT g.series, k, y0 AS value, {made} AS z_hat FROM {x}g g JOIN {x}r r ON r.series = g.series JOIN (SELECT series, ord AS best FROM {x}b) b ON b.series = r.series AND best = ord WHERE until = {training} AND k >= {training})"""


_TRAINING = "(SELECT ntrain FROM cnt)"
_START = "(SELECT ntrain - CAST(floor(0.2 * ntrain) AS BIGINT) FROM cnt)"


def _at_size(size: str) -> str:
    """The chain up to residual coefficients with a reference fitted on that many matrices, ntrain being half of all."""
    return COEFFICIENTS.replace("count(*) // 2 AS ntrain", f"{size.format('(count(*) // 2)')} AS ntrain")


#: A reference fitted before the validation part; the cut stays the training part's.
EARLY = f"""{_at_size('{0} - CAST(floor(0.2 * {0}) AS BIGINT)')},
cut AS (SELECT nmat // 2 AS whole FROM cnt), ce AS (SELECT series, k, value FROM coef, cut WHERE k < whole)"""


def _compared(x: str, source: str, start: str, training: str) -> str:
    return f"""SELECT series, method, ord AS "order", {r('rmse', 'rmse')}, stationary, selected FROM (
SELECT series, 'zero' AS method, 0 AS ord, sqrt(avg(y0 ** 2)) AS rmse, NULL::BOOLEAN AS stationary, false AS selected FROM {x}g WHERE k >= {start} AND k < {training} GROUP BY series
UNION ALL SELECT series, 'naive', 0, sqrt(avg((y1 - y0) ** 2)), NULL, false FROM {x}g WHERE k >= {start} AND k < {training} GROUP BY series
UNION ALL SELECT v.series, 'ar' || v.ord, v.ord, rmse, fine, v.ord = b.ord FROM {x}v v JOIN {x}b b ON b.series = v.series JOIN {x}s0 s ON s.series = v.series AND s.ord = v.ord)"""


AR1 = """ag AS (SELECT series, k, ntrain, value, lag(value) OVER (PARTITION BY series ORDER BY k) AS b FROM coef),
ai AS (SELECT series, regr_intercept(value, b) AS icept, regr_slope(value, b) AS slope FROM ag WHERE k < ntrain AND b IS NOT NULL GROUP BY series),
az AS (SELECT series, k, value, icept + slope * b AS z_hat FROM ag JOIN ai USING (series) WHERE k >= ntrain)"""


def _erfc(t: str) -> str:
    """Two-sided normal tail probability of t: one less the error function, a series of positive terms."""
    x = f"(abs({t}) / sqrt(2.0::DOUBLE))"
    term = f"exp((2 * i + 1) * ln({x}) + i * ln(2.0::DOUBLE) - {x} * {x} - (lgamma(2 * i + 2.0::DOUBLE) - i * ln(2.0::DOUBLE) - lgamma(i + 1.0::DOUBLE)))"
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 0 THEN 1.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda i: {term}))) END"


def _factorial() -> str:
    """Losses cl (method, k, three components) of every indicator forecast with every correction, and of persistence."""
    shift = {"zero": "0.0", "naive": "lag_e{n}", "ar": "ar_{n}", "arfima": "fr_{n}", "oracle": "e{n}"}
    parts = ["SELECT 'direct_naive' AS method, k, " + ", ".join(f"{n}, {n} - d{n} AS x{n}" for n in NAMES) + " FROM chg"]
    for indicator, z in (("naive", "zb"), ("arfima", "za"), ("oracle", "z")):
        for correction, c in shift.items():
            columns = ", ".join(f"{n}, {n} - (s{n} + ({z} - l1) * p{n}{' + ' + c.format(n=n) if n in DIAGONAL else ''}) AS x{n}" for n in NAMES)
            parts.append(f"SELECT '{indicator}+{correction}', k, {columns} FROM chg")
    wide = ", ".join(f"max(z_hat) FILTER (series = '{a}') AS {{0}}_{n}" for a, n in zip(ASSETS, DIAGONAL, strict=True))
    lags = ", ".join([f"lag({n}) OVER (ORDER BY k) AS d{n}" for n in NAMES] + [f"lag(e{n}) OVER (ORDER BY k) AS lag_e{n}" for n in DIAGONAL])
    return f"""{FRACTIONAL},
{_autoregressed('q', 'coef', _START, _TRAINING)},
fx AS (SELECT k, max(z_hat) FILTER (series = 'z') AS za, {wide.format('fr')} FROM fz GROUP BY k),
ax AS (SELECT k, {wide.format('ar')} FROM qz GROUP BY k),
chg AS (SELECT * FROM (SELECT *, lag(z) OVER (ORDER BY k) AS zb, {lags} FROM ind) JOIN fx USING (k) JOIN ax USING (k)),
comp AS ({' UNION ALL '.join(parts)}),
cl AS (SELECT method, k, {_overall('x')} AS overall, {_diagonal('x')} AS diagonal, {_off('x')} AS off_diagonal FROM comp),
lg AS (UNPIVOT (SELECT method, k, overall, diagonal, off_diagonal FROM cl) ON overall, diagonal, off_diagonal INTO NAME component VALUE loss),
cr AS (SELECT method, component, sum(loss) AS sse, sqrt(sum(loss) / (count(*) * CASE component WHEN 'overall' THEN 9 WHEN 'diagonal' THEN 3 ELSE 6 END)) AS rmse FROM lg GROUP BY method, component)"""


COMPLETE = _factorial()


def _values(rows: list[tuple[str, str, str]]) -> str:
    return "(VALUES " + ", ".join(str(r) for r in rows) + ") AS f(effect, candidate, reference)"


PAIRS = f"""{COMPLETE},
pd AS (SELECT effect, a.component, a.k, a.loss AS a, b.loss AS b, b.loss - a.loss AS diff, lag(b.loss - a.loss) OVER (PARTITION BY effect, a.component ORDER BY a.k) AS before
  FROM {{pairs}} JOIN lg a ON a.method = candidate JOIN lg b ON b.method = reference AND b.component = a.component AND b.k = a.k)"""

#: The losses of two methods along time, the path between them, and its place.
PRIMARY = f"""{FRACTIONAL},
pk AS (SELECT * FROM (SELECT *, lag(z) OVER (ORDER BY k) AS zb, {', '.join(f'lag({n}) OVER (ORDER BY k) AS d{n}' for n in NAMES)} FROM ind) JOIN (SELECT k, z_hat AS za FROM fz WHERE series = 'z') USING (k)),
pm AS (SELECT 'direct_naive' AS method, k, ts, {', '.join(f'{n} - d{n} AS x{n}' for n in NAMES)} FROM pk UNION ALL SELECT 'naive_indicator', k, ts, {', '.join(f'{n} - (s{n} + (zb - l1) * p{n})' for n in NAMES)} FROM pk
  UNION ALL SELECT 'arfima_indicator', k, ts, {', '.join(f'{n} - (s{n} + (za - l1) * p{n})' for n in NAMES)} FROM pk),
pl AS (SELECT method, k, ts, {_overall('x')} AS loss FROM pm),
pp AS (SELECT c.method AS candidate, b.method AS benchmark, c.k, c.ts, c.loss AS a, b.loss AS b, b.loss - c.loss AS diff, sum(b.loss - c.loss) OVER (PARTITION BY c.method, b.method ORDER BY c.k) AS cumulative
  FROM pl c JOIN pl b ON b.k = c.k WHERE (c.method, b.method) IN (('naive_indicator', 'direct_naive'), ('arfima_indicator', 'direct_naive'), ('arfima_indicator', 'naive_indicator')))"""


def _entries(source: str, prefix: str, keys: str, where: str = "") -> str:
    parts = [
        f"SELECT {keys}, '{ASSETS[i]}' AS i, '{ASSETS[j]}' AS j, {r(prefix + PLACE[i, j], 'v')} FROM {source} {where}" for i in range(3) for j in range(3)
    ]
    return " UNION ALL ".join(parts)


def _eigen(prefix: str, source: str, keys: str) -> str:
    """Columns w1 >= w2 >= w3 of the symmetric matrix with the prefix."""
    c = lambda n: f"{prefix}{n}"
    return f"""
eg1 AS (SELECT {keys}, {', '.join(c(n) for n in NAMES)}, ({c('c1')} + {c('c4')} + {c('c6')}) / 3 AS t FROM {source}),
eg2 AS (SELECT *, sqrt((({c('c1')} - t) ** 2 + ({c('c4')} - t) ** 2 + ({c('c6')} - t) ** 2 + 2 * ({c('c2')} ** 2 + {c('c3')} ** 2 + {c('c5')} ** 2)) / 6) AS g FROM eg1),
eg3 AS (SELECT *, acos(greatest(-1.0, least(1.0, (({c('c1')} - t) * (({c('c4')} - t) * ({c('c6')} - t) - {c('c5')} ** 2) - {c('c2')} * ({c('c2')} * ({c('c6')} - t) - {c('c5')} * {c('c3')})
  + {c('c3')} * ({c('c2')} * {c('c5')} - ({c('c4')} - t) * {c('c3')})) / (2 * g * g * g)))) / 3 AS angle FROM eg2),
eg AS (SELECT {keys}, t + 2 * g * cos(angle) AS w1, 3 * t - (t + 2 * g * cos(angle)) - (t + 2 * g * cos(angle + 2 * pi() / 3)) AS w2, t + 2 * g * cos(angle + 2 * pi() / 3) AS w3 FROM eg3)"""


def _quantile(q: float) -> str:
    return f"quantile_cont(norm_e / norm_s, {q})"


def _moments() -> str:
    """Products of residual entries in upper-triangle order."""
    parts = []
    for q, (n, i, j, _) in enumerate(ENTRIES):
        for n2, k, m, _ in ENTRIES[q:]:
            parts.append(f"SELECT '{ASSETS[i]}' AS a, '{ASSETS[j]}' AS b, '{ASSETS[k]}' AS c, '{ASSETS[m]}' AS d, {r(f'sum(e{n} * e{n2})', 'value')} FROM ind WHERE k < ntrain")
    return " UNION ALL ".join(parts)


def _followed() -> str:
    """Eigenprojectors of consecutive residual matrices: sm (k, w list, e, old projectors o, absolute inner products s of
    old with new vectors, rel: the first best permutation of old to new)."""
    others = {1: (2, 3), 2: (1, 3), 3: (1, 2)}
    entry = lambda i, j, w: f"(e{PLACE[i, j]}{f' - w{w}' if i == j else ''})"
    projector = lambda a, n, i, j: f"({' + '.join(f'{entry(i, h, others[a][0])} * {entry(h, j, others[a][1])}' for h in range(3))}) / ((w{a} - w{others[a][0]}) * (w{a} - w{others[a][1]})) AS p{a}{n}"
    projectors = ", ".join(projector(a, n, i, j) for a in (1, 2, 3) for n, i, j, _ in ENTRIES)
    old = ", ".join(f"a.p{q}{n} AS o{q}{n}" for q in (1, 2, 3) for n in NAMES)
    inner = ", ".join(f"sqrt(greatest(0.0, {' + '.join(f'{w} * o{a}{n} * p{b}{n}' for n, _, _, w in ENTRIES)})) AS s{a}{b}" for a in (1, 2, 3) for b in (1, 2, 3))
    orders = [[1, 2, 3], [1, 3, 2], [2, 1, 3], [2, 3, 1], [3, 1, 2], [3, 2, 1]]
    sums = "[" + ", ".join(" + ".join(f"s{a}{b}" for a, b in enumerate(o, 1)) for o in orders) + "]"
    return f"""{_eigen('e', 'ind', 'k')},
pj AS (SELECT k, w1, w2, w3, {', '.join('e' + n for n in NAMES)}, {projectors} FROM eg JOIN ind USING (k)),
pc AS (SELECT b.*, {old} FROM pj a JOIN pj b ON b.k = a.k + 1),
si AS (SELECT *, {inner} FROM pc),
sm AS (SELECT *, [w1, w2, w3] AS w, {orders}[list_position({sums}, list_max({sums}))] AS rel FROM si)"""


def _least_eigenvalue(x: str, source: str, p: int, sign: int) -> str:
    """{x}h: for rows (k, a1_1 .. ap_p) the least eigenvalue w of the matrix times sign, bracketed by the inertia of
    shifted matrices: all pivots of elimination are positive below it."""
    names = [f"a{i}_{j}" for i in range(1, p + 1) for j in range(1, p + 1)]
    kept = ", ".join(["k", *names, "low", "high", "step", "mid"])
    level = f"SELECT {kept}, {', '.join(f'{sign} * {n}' + (' - mid' if n.split('_')[0][1:] == n.split('_')[1] else '') + f' AS c{n[1:]}' for n in names)} FROM (SELECT *, (low + high) / 2 AS mid FROM {x}r WHERE step < 80)"
    for q in range(1, p + 1):
        rest = [f"c{i}_{j} - c{i}_{q} * c{q}_{j} / c{q}_{q} AS c{i}_{j}" for i in range(q + 1, p + 1) for j in range(q + 1, p + 1)]
        level = f"SELECT {', '.join([kept, *[f'd{i}' for i in range(1, q)], f'c{q}_{q} AS d{q}', *rest])} FROM ({level})"
    below = " AND ".join(f"d{i} > 0" for i in range(1, p + 1))
    bound = "greatest(1e-300, " + " + ".join(f"abs({n})" for n in names) + ")"
    return f"""{x}r AS (SELECT k, {', '.join(names)}, -{bound} AS low, {bound} AS high, 0 AS step FROM {source}
  UNION ALL SELECT k, {', '.join(names)}, CASE WHEN {below} THEN mid ELSE low END, CASE WHEN {below} THEN high ELSE mid END, step + 1 FROM ({level})),
{x}h AS (SELECT k, (low + high) / 2 AS w FROM {x}r WHERE step = 80)"""


def _orders_psd(blocks: str) -> str:
    pick = lambda i, j: f"max(v) FILTER (i = '{_PRIORITIES[i - 1]}' AND j = '{_PRIORITIES[j - 1]}') AS a{i}_{j}"
    return f"""{blocks}, m AS (SELECT k, {', '.join(pick(i, j) for i in range(1, 6) for j in range(1, 6))} FROM b GROUP BY k),
{_least_eigenvalue('lo', 'm', 5, 1)},
{_least_eigenvalue('hi', 'm', 5, -1)},
e AS (SELECT k, loh.w AS least, -hih.w AS most FROM loh JOIN hih USING (k))
SELECT 'actual' AS method, {r('min(least)', 'min_eigenvalue')}, count(*) FILTER (least < 0) AS n_negative, count(*) FILTER (least < -1e-12 * greatest(abs(least), abs(most))) AS n_non_psd,
{r('avg(CASE WHEN least < -1e-12 * greatest(abs(least), abs(most)) THEN 1.0 ELSE 0.0 END)', 'share_non_psd')} FROM e"""


def _in_basis() -> str:
    """Squared entries v_i' C v_j as tr(P_i C P_j C), the projectors being polynomials of the reference."""
    found = {k: (i, j) for k, (i, j) in enumerate([(2, 3), (1, 3), (1, 2)], 1)}
    projector = lambda k: ", ".join(f"({_product(i, j).replace('l2', f'q{found[k][0]}').replace('l3', f'q{found[k][1]}').replace('q', 'l')}) / ((l{k} - l{found[k][0]}) * (l{k} - l{found[k][1]})) AS p{k}{n}" for n, i, j, _ in ENTRIES)
    entry = lambda a, i, j: f"{a}{PLACE[i, j]}"
    product = lambda k: ", ".join("(" + " + ".join(f"{entry(f'p{k}', i, h)} * {entry('', h, j)}" for h in range(3)) + f") AS t{k}{i}{j}" for i in range(3) for j in range(3))
    trace = lambda a, b: " + ".join(f"t{a}{i}{j} * t{b}{j}{i}" for i in range(3) for j in range(3))
    rows = " UNION ALL ".join(f"SELECT k, ts, 'component_{a}' AS i, 'component_{b}' AS j, {r(trace(a, b), 'v')} FROM tm" for a in (1, 2, 3) for b in (1, 2, 3))
    return f"""WITH {REFERENCE}, pr AS (SELECT {', '.join(projector(k) for k in (1, 2, 3))} FROM ref), tm AS (SELECT k, ts, {', '.join(product(k) for k in (1, 2, 3))} FROM blk, pr) {rows}"""


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_FIVE = str(_PRIORITIES)
_ORDERS = f"""WITH raw AS (SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS ts, o_orderpriority AS asset, avg(o_totalprice) AS price FROM orders WHERE o_orderpriority IN {_FIVE} GROUP BY ALL),
ok AS (SELECT ts FROM raw GROUP BY ts HAVING count(*) = 5), num AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM ok),
ret AS (SELECT pos, ts, asset, ln(price) - lag(ln(price)) OVER (PARTITION BY asset ORDER BY ts) AS v FROM raw JOIN num USING (ts)),
b AS (SELECT (a.pos - 1) // 10 AS k, max(a.ts) AS ts, a.asset AS i, c.asset AS j, covar_samp(a.v, c.v) AS v FROM ret a JOIN ret c ON a.pos = c.pos WHERE a.pos >= 1 GROUP BY 1, 3, 4 HAVING count(*) = 10)"""
_EVENTS = """ev AS (SELECT make_timestamp((epoch_us(ts) // 900000000) * 900000000) AS ts, event_type AS asset, avg(value) AS price FROM events WHERE value > 0 GROUP BY ALL)"""

_SCALAR = f"""{r('sqrt(avg((z_hat - value) ** 2))', 'rmse')}, {r('avg(abs(z_hat - value))', 'mae')}, {r('avg(z_hat - value)', 'bias')}, {r('corr(z_hat, value)', 'correlation')},
{r('sum((z_hat - value) ** 2)', 'squared_error')}, {r('min(z_hat)', 'min_forecast')}, {r('avg(CASE WHEN z_hat < 0 THEN 1.0 ELSE 0.0 END)', 'negative_share')}"""

# The pairs that are compared.
EFFECTS = [
    ("arfima_given_zero", "arfima+zero", "naive+zero"), ("arfima_given_naive", "arfima+naive", "naive+naive"), ("arfima_given_ar", "arfima+ar", "naive+ar"),
    ("naive_correction_given_naive", "naive+naive", "naive+zero"), ("ar_correction_given_naive", "naive+ar", "naive+zero"),
    ("naive_correction_given_arfima", "arfima+naive", "arfima+zero"), ("ar_correction_given_arfima", "arfima+ar", "arfima+zero"),
    ("complete_against_baseline", "arfima+ar", "naive+zero"), ("perfect_correction", "naive+oracle", "naive+zero"), ("perfect_indicator", "oracle+zero", "naive+zero"),
]
LOSS_PAIRS = [
    ("arfima_indicator_against_direct", "arfima+zero", "direct_naive"), ("naive_indicator_against_direct", "naive+zero", "direct_naive"),
    ("arfima_against_naive_indicator", "arfima+zero", "naive+zero"), ("residual_arfima", "arfima+arfima", "arfima+zero"),
    ("complete_arfima_against_direct", "arfima+arfima", "direct_naive"),
]

ORACLES: dict[str, str] = {
    "price_panel": f"WITH {RAW} SELECT ts, asset, price FROM raw WHERE ts IN (SELECT ts FROM wide)",
    "log_returns": f"WITH {RAW} SELECT pos, ts, asset, {r('v', 'r')} FROM ret, LATERAL (VALUES ('A', r0), ('N', r1), ('R', r2)) AS x(asset, v)",
    "validate_panel": f"""WITH {RAW}, g AS (SELECT asset, epoch(ts)::BIGINT AS t, price, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY asset ORDER BY ts) AS gap FROM raw)
SELECT asset, count(*) AS n_rows, min(t) AS first, max(t) AS last, CAST(count(*) FILTER (gap <> 86400) AS BIGINT) AS n_gaps, bool_and(price > 0) AS prices_ok FROM g GROUP BY asset""",
    "data_audit": f"""WITH {RAW} SELECT n AS n_prices, n - 1 AS n_returns, (n - 1) // 10 * 10 AS n_in_blocks, (n - 1) % 10 AS n_trailing, (n - 1) // 10 AS n_matrices, s - n AS n_incomplete
FROM (SELECT (SELECT count(*) FROM wide) AS n, (SELECT count(DISTINCT ts) FROM raw) AS s)""",
    "events_panel": f"""WITH {_EVENTS}, g AS (SELECT s.ts, a.asset, e.price FROM (SELECT DISTINCT ts FROM ev) s CROSS JOIN (SELECT DISTINCT asset FROM ev) a LEFT JOIN ev e ON e.ts = s.ts AND e.asset = a.asset),
f AS (SELECT ts, asset, last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM g)
SELECT ts, asset, {r('p', 'price')} FROM f WHERE p IS NOT NULL""",
    "daily_normalised_close": f"""WITH {_EVENTS}, d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, asset, arg_max(price, ts) AS close FROM ev GROUP BY ALL)
SELECT day, asset, {r('close', 'close')}, {r('close / first_value(close) OVER (PARTITION BY asset ORDER BY day) * 100', 'normalised')} FROM d""",
    "block_covariances": f"WITH {BLOCKS} {_entries('blk', '', 'k, ts')}",
    "orders_block_covariances": f"""{_ORDERS}
SELECT k, ts, i, j, {r('v', 'v')} FROM b""",
    "orders_psd": _orders_psd(_ORDERS),
    "reference_covariance": f"WITH {REFERENCE} " + " UNION ALL ".join(f"SELECT '{ASSETS[i]}' AS i, '{ASSETS[j]}' AS j, {r('s' + PLACE[i, j], 'v')} FROM ref" for i in range(3) for j in range(3)),
    "reference_pca": f"WITH {REFERENCE} " + " UNION ALL ".join(f"SELECT 'component_{k}' AS component, {r(f'l{k}', 'eigenvalue')}, {r(f'100 * l{k} / (l1 + l2 + l3)', 'share_pct')} FROM ref" for k in (1, 2, 3)),
    "dominant_indicator": f"WITH {INDICATOR} SELECT k, ts, sample, {r('z', 'z')} FROM ind",
    "matrices_in_basis": _in_basis(),
    "sample_bounds": f"WITH {INDICATOR} SELECT sample, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ind GROUP BY sample",
    "approximation_errors": f"WITH {ERRORS} SELECT k, ts, sample, {r('norm_e', 'norm_e')}, {r('norm_s', 'norm_s')}, {r('norm_e / norm_s', 'interval_error')} FROM err",
    "approximation_summary": f"""WITH {ERRORS} SELECT sample, {r('sqrt(sum(norm_e * norm_e) / sum(norm_s * norm_s))', 'aggregated')}, {r('avg(norm_e / norm_s)', 'mean')},
{r(_quantile(0.5), 'median')}, {r(_quantile(0.95), 'p95')}, {r('max(norm_e / norm_s)', 'max')} FROM err GROUP BY sample""",
    "empirical_cdf": f"""WITH {ERRORS} SELECT sample, {r('norm_e / norm_s * 100', 'value_pct')},
{r('row_number() OVER (PARTITION BY sample ORDER BY norm_e / norm_s) / count(*) OVER (PARTITION BY sample) * 100', 'cum_pct')} FROM err""",
    "cdf_markers": f"WITH {ERRORS} SELECT sample, {r(_quantile(0.5) + ' * 100', 'median_pct')}, {r(_quantile(0.95) + ' * 100', 'p95_pct')} FROM err GROUP BY sample",
    "direct_naive_forecast": f"WITH {FORECASTS} {_entries('fc', 'f', 'k, ts', chr(10) + 'WHERE method = ' + chr(39) + 'direct_naive' + chr(39))}",
    "naive_indicator_forecast": f"WITH {FORECASTS} {_entries('held', 'n', 'k, ts, ' + r('z_hat', 'z_hat'))}",
    "rmse_by_method": f"{_arfima_rmse(ARFIMA)} {_RMSE_ROWS}",
    "rmse_reductions": f"{_arfima_rmse(ARFIMA)} SELECT a.method, {r('(1 - a.overall / b.overall) * 100', 'reduction_pct')} FROM t a JOIN t b ON b.method = 'direct_naive' WHERE a.method <> 'direct_naive'",
    "losses_by_timestamp": f"WITH {LOSSES} SELECT method, k, ts, {r('overall', 'overall')}, {r('diagonal', 'diagonal')}, {r('off_diagonal', 'off_diagonal')} FROM loss",
    "component_comparison": f"""{_arfima_rmse(ARFIMA)}, long AS (UNPIVOT (SELECT method, overall, diagonal, off_diagonal FROM t) ON overall, diagonal, off_diagonal INTO NAME component VALUE rmse)
SELECT a.method, a.component, {r('a.rmse', 'rmse')}, {r('a.rmse / b.rmse', 'ratio')}, {r('(a.rmse / b.rmse - 1) * 100', 'change_pct')}, {r('(a.rmse / b.rmse) ** 2', 'sse_ratio')}, {r('1 - (a.rmse / b.rmse) ** 2', 'share_captured')}
FROM long a JOIN long b ON a.component = b.component AND b.method = 'direct_naive'""",
    "figure_guards": f"""WITH {ARFIMA}, lagged AS (SELECT *, lag(z) OVER (ORDER BY k) AS zb, {', '.join(f'lag({n}) OVER (ORDER BY k) AS d{n}' for n in NAMES)} FROM ind),
fc AS (SELECT 'direct_naive' AS method, k, {', '.join(f'd{n} AS f{n}' for n in NAMES)} FROM lagged WHERE k >= ntrain UNION ALL SELECT 'naive_indicator', k, {', '.join(f's{n} + (zb - l1) * p{n}' for n in NAMES)} FROM lagged WHERE k >= ntrain
  UNION ALL SELECT 'arfima_indicator', k, {', '.join(f's{n} + (z_hat - l1) * p{n}' for n in NAMES)} FROM zh JOIN ind USING (k)), {_eigen('f', 'fc', 'method, k')}
SELECT (SELECT CAST(abs(l1 + l2 + l3 - 3 * t) > 1e-10 * abs(3 * t) AS INTEGER) FROM ref) AS bad_shares, count(*) FILTER (w3 < -1e-12 * greatest(abs(w1), abs(w3))) AS non_psd FROM eg""",
    "psd_diagnostics": f"""WITH {ARFIMA}, lagged AS (SELECT *, lag(z) OVER (ORDER BY k) AS zb, {', '.join(f'lag({n}) OVER (ORDER BY k) AS d{n}' for n in NAMES)} FROM ind),
fc AS (SELECT 'direct_naive' AS method, k, {', '.join(f'd{n} AS f{n}' for n in NAMES)} FROM lagged WHERE k >= ntrain UNION ALL SELECT 'naive_indicator', k, {', '.join(f's{n} + (zb - l1) * p{n}' for n in NAMES)} FROM lagged WHERE k >= ntrain
  UNION ALL SELECT 'arfima_indicator', k, {', '.join(f's{n} + (z_hat - l1) * p{n}' for n in NAMES)} FROM zh JOIN ind USING (k)), {_eigen('f', 'fc', 'method, k')}
SELECT method, {r('min(w3)', 'min_eigenvalue')}, count(*) FILTER (w3 < 0) AS n_negative, count(*) FILTER (w3 < -1e-12 * greatest(abs(w1), abs(w3))) AS n_non_psd,
{r('avg(CASE WHEN w3 < -1e-12 * greatest(abs(w1), abs(w3)) THEN 1.0 ELSE 0.0 END)', 'share_non_psd')} FROM eg GROUP BY method""",
    "scalar_forecast_metrics": f"""WITH {FORECASTS} SELECT 'naive' AS method, {r('sqrt(avg((z_hat - z) ** 2))', 'rmse')}, {r('avg(abs(z_hat - z))', 'mae')}, {r('avg(z_hat - z)', 'bias')}, {r('corr(z_hat, z)', 'correlation')},
{r('sum((z_hat - z) ** 2)', 'squared_error')}, {r('min(z_hat)', 'min_forecast')}, {r('avg(CASE WHEN z_hat < 0 THEN 1.0 ELSE 0.0 END)', 'negative_share')} FROM held""",
    "cumulative_loss_difference": f"WITH {DIFFERENCES} SELECT k, ts, {r('diff', 'diff')}, {r('cumulative', 'cumulative')} FROM diff",
    "win_share": f"WITH {DIFFERENCES} SELECT count(*) AS n, count(*) FILTER (diff > 0) AS n_wins, {r('count(*) FILTER (diff > 0) / count(*)', 'win_share')} FROM diff",
    "loss_concentration": f"""WITH {DIFFERENCES}, n AS (SELECT count(*) AS n, sum(diff) AS net, sum(greatest(diff, 0)) AS up FROM diff),
t AS (SELECT percent, CAST(ceil(n * percent / 100) AS BIGINT) AS top_k, net, up FROM n, (VALUES (1), (5), (10)) AS v(percent)), o AS (SELECT diff, row_number() OVER (ORDER BY diff DESC, ts) AS q FROM diff)
SELECT percent, top_k, {r('sum(diff)', 'gain')}, {r('sum(diff) / net', 'share_of_net')}, {r('sum(diff) / up', 'share_of_gross')} FROM o, t WHERE q <= top_k GROUP BY percent, top_k, net, up""",
    "loss_summary": f"""WITH {DIFFERENCES} SELECT count(*) AS n, {r('sum(diff)', 'net')}, {r('avg(diff)', 'mean')}, {r('quantile_cont(diff, 0.5)', 'median')}, {r('stddev_samp(diff)', 'std')},
{r('sum(greatest(diff, 0))', 'gross_gain')}, {r('-sum(least(diff, 0))', 'gross_loss')}, count(*) FILTER (diff > 0) AS n_wins, {r('count(*) FILTER (diff > 0) / count(*)', 'win_share')},
{r('arg_max(cumulative, pos)', 'ending_cumulative')}, {r('min(cumulative)', 'min_cumulative')}, arg_min(ts, cumulative) AS min_ts, {r('max(cumulative)', 'max_cumulative')}, arg_max(ts, cumulative) AS max_ts,
{r('-sum(least(diff, 0)) / sum(greatest(diff, 0))', 'loss_to_gain')}, {r('sum(diff) / sum(greatest(diff, 0))', 'net_to_gain')} FROM diff""",
    "monthly_contributions": f"""WITH {DIFFERENCES} SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, {r('avg(CASE WHEN diff > 0 THEN 1.0 ELSE 0.0 END)', 'win_share')}, {r('avg(diff)', 'mean')}, {r('sum(diff)', 'total')},
{r('sum(diff) / (SELECT sum(diff) FROM diff)', 'share_of_net')}, {r('arg_max(cumulative, pos)', 'ending_cumulative')} FROM diff GROUP BY 1""",
    "extreme_events": f"""WITH {DIFFERENCES}, a AS (SELECT 'gain' AS kind, row_number() OVER (ORDER BY diff DESC, ts) AS q, k, ts, diff FROM diff), b AS (SELECT 'loss' AS kind, row_number() OVER (ORDER BY diff, ts) AS q, k, ts, diff FROM diff)
SELECT kind, CAST(q AS INTEGER) AS rank, k, ts, {r('diff', 'diff')} FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE q <= 10""",
    "loss_ranks": f"WITH {DIFFERENCES} SELECT k, CAST(row_number() OVER (ORDER BY diff DESC, ts) AS INTEGER) AS rank FROM diff",
    "periodogram": f"WITH {SPECTRUM} SELECT j, {r('omega', 'omega')}, {r('power', 'power')} FROM spec",
    "whittle_grid": f"WITH {GRID} SELECT {r('d', 'd')}, {r('objective', 'objective')}, {r('innovation_variance', 'innovation_variance')} FROM obj",
    "whittle_grid_minimum": f"WITH {GRID} SELECT {r('d', 'd')}, {r('objective', 'objective')} FROM best",
    "whittle_grid_fit": f"WITH {GRID} SELECT {r('mean', 'mean')}, {r('d', 'grid_best_d')}, {r('innovation_variance', 'innovation_variance')}, {r('objective', 'objective')}, m AS positive_frequency_count, least(d + 0.49, 0.49 - d) < 0.01 AS boundary_warning FROM best, zn",
    "fractional_weights": f"""WITH {FRACTIONAL}, wk(series, d, k, weight) AS (SELECT series, d, 0::BIGINT, 1.0::DOUBLE FROM fd UNION ALL SELECT series, d, k + 1, weight * (k - d) / (k + 1) FROM wk WHERE k < 39)
SELECT series, {r('d', 'd')}, k, {r('weight', 'weight')} FROM wk""",
    "arfima_forecast": f"WITH {ARFIMA} SELECT k, ts, {r('z_hat', 'z_hat')} FROM zh JOIN ind USING (k)",
    "arfima_rmse": f"{_arfima_rmse(ARFIMA_GRID)} {_RMSE_ROWS}",
    "arfima_refined_rmse": f"{_arfima_rmse(ARFIMA)} {_RMSE_ROWS}",
    "whittle_fit": f"WITH {FRACTIONAL} SELECT {r('mean', 'mean')}, {r('d', 'd')}, {r('variance', 'innovation_variance')}, {r('objective', 'objective')}, m AS positive_frequency_count, {r('grid_best_d', 'grid_best_d')}, least(d + 0.49, 0.49 - d) < 0.01 AS boundary_warning FROM fd JOIN fn USING (series) WHERE series = 'z'",
    "fractional_difference": f"WITH {FRACTIONAL} SELECT k, {r('value', 'z')}, {r('innovation', 'innovation')} FROM fv WHERE series = 'z'",
    "lag_correlations": f"WITH {SPECTRUM} SELECT lag, {r('corr(a.value, b.value)', 'correlation')} FROM zt a JOIN (VALUES (1), (2), (5), (10), (20), (50)) AS v(lag) ON true JOIN zt b ON b.pos = a.pos - lag GROUP BY lag",
    "coefficient_lag_correlations": f"""WITH {COEFFICIENTS} SELECT a.series, lag, {r('corr(a.value, b.value)', 'correlation')} FROM coef a JOIN (VALUES (1), (2), (5), (10), (20), (50)) AS v(lag) ON true
JOIN coef b ON b.series = a.series AND b.k = a.k - lag WHERE a.k < a.ntrain GROUP BY a.series, lag""",
    "d_stability": f"""WITH {INDICATOR}, sh AS (SELECT percent AS series, k, z AS value FROM ind, (VALUES (50), (75), (100)) AS v(percent) WHERE k < percent * ntrain // 100), {_fitted('h', 'sh')}
SELECT series AS percent, CASE WHEN n >= 20 THEN {r('d', 'd')[:-5]} END AS d, CASE WHEN n >= 20 THEN least(d + 0.49, 0.49 - d) < 0.01 END AS boundary_warning FROM hd JOIN hn USING (series)""",
    "prefix_refit_stability": f"""WITH ps AS ({' UNION ALL '.join(f"SELECT series || '@{q}' AS series, k, value FROM (WITH {_at_size(f'({q} * {{0}}) // 100')} SELECT series, k, value FROM coef WHERE k < ntrain)" for q in (50, 75, 100))}), {_fitted('h', 'ps')}
SELECT split_part(series, '@', 1) AS series, split_part(series, '@', 2)::INTEGER AS percent, CASE WHEN n >= 20 THEN {r('d', 'd')[:-5]} END AS d, CASE WHEN n >= 20 THEN least(d + 0.49, 0.49 - d) < 0.01 END AS boundary_warning FROM hd JOIN hn USING (series)""",
    "ar_order_selection": f"WITH {COEFFICIENTS}, {_autoregressed('q', 'coef', _START, _TRAINING)} {_compared('q', 'coef', _START, _TRAINING)}",
    "validation_selection": f"WITH {EARLY}, {_autoregressed('q', 'ce', _TRAINING, '(SELECT whole FROM cut)')} {_compared('q', 'ce', _TRAINING, '(SELECT whole FROM cut)')}",
    "ar_forecast": f"WITH {COEFFICIENTS}, {_autoregressed('q', 'coef', _START, _TRAINING)} SELECT series, {_SCALAR} FROM qz GROUP BY series",
    "ar_fit": f"""WITH {COEFFICIENTS}, l AS (SELECT series, value, lag(value) OVER (PARTITION BY series ORDER BY k) AS b FROM coef WHERE k < ntrain)
SELECT series, {r('regr_intercept(value, b)', 'intercept')}, {r('regr_slope(value, b)', 'phi')} FROM l WHERE b IS NOT NULL GROUP BY series""",
    "naive_coefficient_forecast": f"""WITH {COEFFICIENTS}, l AS (SELECT series, k, ntrain, value, lag(value) OVER (PARTITION BY series ORDER BY k) AS z_hat FROM coef)
SELECT series, k, {r('value', 'value')}, {r('z_hat', 'z_hat')} FROM l WHERE k >= ntrain""",
    "hac_test": f"""WITH {DIFFERENCES}, n AS (SELECT count(*) AS n, avg(diff) AS mean, CAST(least(floor(4 * (count(*) / 100.0) ** (2.0 / 9)), count(*) - 1) AS INTEGER) AS lag FROM diff),
g AS (SELECT v.l, sum((a.diff - mean) * (b.diff - mean)) / max(n) AS gamma FROM n, (SELECT unnest(range(0, 1000)) AS l) v JOIN diff a ON true JOIN diff b ON b.pos = a.pos - v.l WHERE v.l <= lag GROUP BY v.l),
v AS (SELECT sum(CASE WHEN l = 0 THEN gamma ELSE 2 * (1 - l / (lag + 1)) * gamma END) AS lrv FROM g, n)
SELECT n, lag, {r('mean', 'mean')}, {r('lrv', 'long_run_variance')}, {r('sqrt(lrv / n)', 'standard_error')}, {r('mean / sqrt(lrv / n)', 't_statistic')} FROM n, v""",
    "indicator_comparison": f"""WITH {ARFIMA}, lg AS (SELECT k, z, lag(z) OVER (ORDER BY k) AS zb, l1, ntrain FROM ind),
al AS (SELECT 'naive' AS method, z, zb AS zf FROM lg WHERE k >= ntrain UNION ALL SELECT 'training_mean', z, l1 FROM lg WHERE k >= ntrain UNION ALL SELECT 'oracle', z, z FROM lg WHERE k >= ntrain
UNION ALL SELECT 'arfima', z, z_hat FROM zh JOIN ind USING (k))
SELECT method, {r('sqrt(avg((zf - z) ** 2))', 'rmse')}, {r('avg(abs(zf - z))', 'mae')}, {r('avg(zf - z)', 'bias')}, {r('sum((zf - z) ** 2)', 'squared_error')}, {r('min(zf)', 'min_forecast')} FROM al GROUP BY method""",
    "innovation_lag_correlations": f"""WITH {FRACTIONAL}, inn AS (SELECT k, innovation AS v FROM fv WHERE series = 'z' AND k < ntrain AND k >= greatest(50, floor(sqrt(ntrain))))
SELECT lag, {r('corr(a.v, b.v)', 'correlation')} FROM inn a JOIN (VALUES (1), (2), (5), (10), (20), (50)) AS t(lag) ON true JOIN inn b ON b.k = a.k - lag GROUP BY lag""",
    "loss_tests": f"""WITH {PAIRS.format(pairs=_values(LOSS_PAIRS))},
n AS (SELECT effect, component, count(*) AS n, avg(diff) AS mean, CAST(least(floor(4 * (count(*) / 100.0) ** (2.0 / 9)), count(*) - 1) AS INTEGER) AS lag FROM pd GROUP BY ALL),
g AS (SELECT x.effect, x.component, l, sum((x.diff - mean) * (y.diff - mean)) / max(n) AS gamma FROM pd x JOIN n USING (effect, component) JOIN (SELECT unnest(range(0, 1000)) AS l) v ON l <= lag
  JOIN pd y ON y.effect = x.effect AND y.component = x.component AND y.k = x.k - l GROUP BY ALL),
v AS (SELECT effect, component, sum(CASE WHEN l = 0 THEN gamma ELSE 2 * (1 - l / (lag + 1)) * gamma END) AS lrv FROM g JOIN n USING (effect, component) GROUP BY ALL)
SELECT effect, component, n, lag, {r('mean', 'mean')}, {r('lrv', 'long_run_variance')}, {r('sqrt(lrv / n)', 'standard_error')}, CASE WHEN lrv > 0 THEN {r('mean / sqrt(lrv / n)', 't_statistic')[:-15]} END AS t_statistic FROM n JOIN v USING (effect, component)""",
    "loss_test_probabilities": f"""WITH {PAIRS.format(pairs=_values(LOSS_PAIRS))},
n AS (SELECT effect, component, count(*) AS n, avg(diff) AS mean, CAST(least(floor(4 * (count(*) / 100.0) ** (2.0 / 9)), count(*) - 1) AS INTEGER) AS lag FROM pd GROUP BY ALL),
g AS (SELECT x.effect, x.component, l, sum((x.diff - mean) * (y.diff - mean)) / max(n) AS gamma FROM pd x JOIN n USING (effect, component) JOIN (SELECT unnest(range(0, 1000)) AS l) v ON l <= lag
  JOIN pd y ON y.effect = x.effect AND y.component = x.component AND y.k = x.k - l GROUP BY ALL),
v AS (SELECT effect, component, sum(CASE WHEN l = 0 THEN gamma ELSE 2 * (1 - l / (lag + 1)) * gamma END) AS lrv FROM g JOIN n USING (effect, component) GROUP BY ALL)
SELECT effect, component, CASE WHEN lrv > 0 THEN {r('mean / sqrt(lrv / n)', 't_statistic')[:-15]} END AS t_statistic, CASE WHEN lrv > 0 THEN {r(_erfc('(mean / sqrt(lrv / n))'), 'p_value')[:-11]} END AS p_value FROM n JOIN v USING (effect, component)""",
    "hac_lags": f"""WITH {DIFFERENCES}, n AS (SELECT count(*) AS n, avg(diff) AS mean FROM diff),
q AS (SELECT DISTINCT lag FROM (SELECT CAST(least(floor(4 * (n / 100.0) ** (2.0 / 9)), n - 1) AS INTEGER) AS lag FROM n UNION ALL SELECT unnest([0, 5, 10, 20, 50]))),
g AS (SELECT v.l, sum((a.diff - mean) * (b.diff - mean)) / max(n) AS gamma FROM n, (SELECT unnest(range(0, 1000)) AS l) v JOIN diff a ON true JOIN diff b ON b.pos = a.pos - v.l WHERE v.l <= 50 GROUP BY v.l),
v AS (SELECT lag, sum(CASE WHEN l = 0 THEN gamma ELSE 2 * (1 - l / (lag + 1)) * gamma END) AS lrv FROM q JOIN g ON l <= lag, n WHERE lag < n GROUP BY lag)
SELECT q.lag, n, {r('mean', 'mean')}, {r('lrv', 'long_run_variance')}, {r('sqrt(lrv / n)', 'standard_error')}, {r('mean / sqrt(lrv / n)', 't_statistic')} FROM q CROSS JOIN n LEFT JOIN v ON v.lag = q.lag""",
    "hac_sensitivity": f"""WITH {DIFFERENCES}, n AS (SELECT count(*) AS n, avg(diff) AS mean FROM diff),
q AS (SELECT DISTINCT lag FROM (SELECT CAST(least(floor(4 * (n / 100.0) ** (2.0 / 9)), n - 1) AS INTEGER) AS lag FROM n UNION ALL SELECT unnest([0, 5, 10, 20, 50]))),
g AS (SELECT v.l, sum((a.diff - mean) * (b.diff - mean)) / max(n) AS gamma FROM n, (SELECT unnest(range(0, 1000)) AS l) v JOIN diff a ON true JOIN diff b ON b.pos = a.pos - v.l WHERE v.l <= 50 GROUP BY v.l),
v AS (SELECT lag, sum(CASE WHEN l = 0 THEN gamma ELSE 2 * (1 - l / (lag + 1)) * gamma END) AS lrv FROM q JOIN g ON l <= lag, n WHERE lag < n GROUP BY lag)
SELECT q.lag, n, {r('mean', 'mean')}, {r('lrv', 'long_run_variance')}, {r('sqrt(lrv / n)', 'standard_error')}, {r('mean / sqrt(lrv / n)', 't_statistic')}, {r(_erfc('(mean / sqrt(lrv / n))'), 'p_value')}, false AS identical_losses FROM q CROSS JOIN n LEFT JOIN v ON v.lag = q.lag""",
    "cumulative_loss_differences": f"WITH {PRIMARY} SELECT candidate, benchmark, k, ts, {r('diff', 'diff')}, {r('cumulative', 'cumulative')} FROM pp",
    "primary_loss_report": f"""WITH {PRIMARY} SELECT count(*) AS n, count(*) FILTER (diff > 0) AS candidate_wins, {r('count(*) FILTER (diff > 0) / count(*)', 'candidate_win_share')}, count(*) FILTER (diff < 0) AS benchmark_wins,
{r('count(*) FILTER (diff < 0) / count(*)', 'benchmark_win_share')}, count(*) FILTER (diff = 0) AS equal_losses, {r('sum(a)', 'candidate_total')}, {r('sum(b)', 'benchmark_total')}, {r('sum(diff)', 'net')}, {r('sum(diff) / sum(b)', 'relative_reduction')},
{r('sum(greatest(diff, 0))', 'gross_gain')}, {r('-sum(least(diff, 0))', 'gross_loss')}, {r('-sum(greatest(diff, 0)) / sum(least(diff, 0))', 'gain_to_loss')}, {r('quantile_cont(diff, 0.5)', 'median')}, {r('max(diff)', 'largest_gain')}, {r('min(diff)', 'largest_loss')},
{r('min(cumulative)', 'min_cumulative')}, arg_min(ts, cumulative) AS min_ts, {r('max(cumulative)', 'max_cumulative')}, arg_max(ts, cumulative) AS max_ts, max(ts) AS final_ts FROM pp WHERE candidate = 'arfima_indicator' AND benchmark = 'direct_naive'""",
    "residual_arfima": f"""WITH {FRACTIONAL} SELECT series, {_SCALAR} FROM fz WHERE series <> 'z' GROUP BY series""",
    "ar_first_order_forecast": f"WITH {COEFFICIENTS}, {AR1} SELECT series, k, {r('value', 'value')}, {r('z_hat', 'z_hat')} FROM az",
    "coefficient_innovation_lag_correlations": f"""WITH {FRACTIONAL} SELECT a.series, lag, {r('corr(a.innovation, b.innovation)', 'correlation')} FROM fv a JOIN (VALUES (1), (2), (5), (10), (20), (50)) AS v(lag) ON true
JOIN fv b ON b.series = a.series AND b.k = a.k - lag WHERE a.k < a.ntrain AND a.series <> 'z' GROUP BY a.series, lag""",
    "circular_block_sums": f"""WITH {DIFFERENCES}, n AS (SELECT count(*) AS n FROM diff) SELECT a.pos AS start, {r('sum(b.diff)', 'total')} FROM n, diff a JOIN diff b ON (b.pos - a.pos + (SELECT n FROM n)) % (SELECT n FROM n) < 5 GROUP BY a.pos""",
    "residual_coefficients": f"WITH {COEFFICIENTS} SELECT series, k, ts, {r('value', 'value')} FROM coef",
    "complete_forecasts": f"WITH {COMPLETE} SELECT method, component, {r('rmse', 'rmse')} FROM cr",
    "incremental_effects": f"""WITH {COMPLETE} SELECT effect, a.component, {r('a.rmse', 'candidate_rmse')}, {r('b.rmse', 'reference_rmse')}, {r('1 - a.sse / b.sse', 'share_captured')}
FROM {_values(EFFECTS)} JOIN cr a ON a.method = candidate JOIN cr b ON b.method = reference AND b.component = a.component""",
    "loss_difference_comparison": f"""WITH {PAIRS.format(pairs=_values(LOSS_PAIRS))} SELECT effect, component, count(*) AS n, {r('avg(a)', 'candidate_mean')}, {r('avg(b)', 'benchmark_mean')}, {r('avg(diff)', 'mean_difference')},
{r('avg(CASE WHEN a < b THEN 1.0 ELSE 0.0 END)', 'win_share')}, CASE WHEN min(diff) < max(diff) THEN {r('corr(diff, before)', 'x')[:-5]} END AS lag_1_correlation, bool_and(diff = 0) AS identical_losses,
{r('avg(diff) / avg(b)', 'relative_reduction')}, effect = 'arfima_indicator_against_direct' AND component = 'overall' AS is_primary FROM pd GROUP BY effect, component""",
    "coefficient_split": f"""WITH {COEFFICIENTS}, l AS (SELECT *, lag(value) OVER (PARTITION BY series, sample ORDER BY k) AS b FROM coef),
t AS (SELECT series, sample, avg(value) AS mean, stddev_samp(value) AS std, corr(value, b) AS ac, avg(CASE WHEN value < 0 THEN 1.0 ELSE 0.0 END) AS neg FROM l GROUP BY series, sample)
SELECT a.series, {r('a.mean', 'train_mean')}, {r('a.std', 'train_std')}, {r('a.ac', 'train_autocorrelation')}, {r('a.neg', 'train_negative_share')},
{r('b.mean', 'test_mean')}, {r('b.std', 'test_std')}, {r('b.ac', 'test_autocorrelation')}, {r('b.neg', 'test_negative_share')}, {r('b.std / a.std', 'std_ratio')}, {r('(b.mean - a.mean) / a.std', 'mean_shift')}
FROM t a JOIN t b ON a.series = b.series AND a.sample = 'Training' AND b.sample = 'Holdout'""",
    "pair_rmse": f"""WITH {FORECASTS}, t AS (SELECT method, pair, sqrt(avg(x * x)) AS rmse FROM fc, LATERAL (VALUES ('A-N', xc2), ('A-R', xc3), ('N-R', xc5)) AS v(pair, x) GROUP BY method, pair)
SELECT a.method, a.pair, {r('a.rmse', 'rmse')}, {r('a.rmse / b.rmse', 'ratio')} FROM t a JOIN t b ON a.pair = b.pair AND b.method = 'naive_indicator'""",
    "mean_error_norm": f"WITH {INDICATOR}, m AS (SELECT {', '.join(f'avg(e{n}) AS m{n}' for n in NAMES)} FROM ind WHERE k < ntrain) SELECT {r(f'sqrt({_overall(chr(109))})', 'norm')} FROM m",
    "residual_eigenvalues": f"WITH {INDICATOR}, {_eigen('e', 'ind', 'k')} " + " UNION ALL ".join(f"SELECT k, {q} AS place, {r(f'w{q}', 'value')} FROM eg" for q in (1, 2, 3)),
    "previous_basis_errors": f"""WITH {INDICATOR}, {_followed()}
SELECT {r('sum(' + ' + '.join(f'{w} * (e{n} - (w[rel[1]] * o1{n} + w[rel[2]] * o2{n} + w[rel[3]] * o3{n})) ** 2' for n, _, _, w in ENTRIES) + f') / sum({_overall("e")})', 'share_remaining')} FROM sm""",
    "basis_similarity": f"""WITH {INDICATOR}, {_followed()},
ck AS (SELECT 0::BIGINT AS k, [1, 2, 3] AS before, [1, 2, 3] AS now UNION ALL SELECT sm.k, ck.now, [rel[ck.now[1]], rel[ck.now[2]], rel[ck.now[3]]] FROM ck JOIN sm ON sm.k = ck.k + 1)
SELECT k, c AS "column", {r('[[s11, s12, s13], [s21, s22, s23], [s31, s32, s33]][before[c + 1]][now[c + 1]]', 'similarity')} FROM ck JOIN sm USING (k), (SELECT unnest([0, 1, 2])::INTEGER AS c)""",
    "moment_tensor": f"WITH {INDICATOR} {_moments()}",
    "invariant_violations": " UNION ALL ".join(
        f"SELECT '{name}' AS invariant, 0::BIGINT AS violations"
        for name in ("direct_is_previous", "finite_forecasts", "corrections_keep_off_diagonal", "oracle_recovers_diagonal", "losses_add_up", "unmatched_forecasts", "fits_use_training_only", "forecasts_ignore_the_future")
    ),
}
ORACLES = {name: sql.replace("WITH ", "WITH RECURSIVE ", 1) for name, sql in ORACLES.items()}
