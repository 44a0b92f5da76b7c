"""The queries again as SQL for DuckDB, written from the definitions."""

from __future__ import annotations

import itertools

import numpy as np

from shoalwise.plans.queries import PERMUTATIONS, SEED, SMOOTH_KNOTS, SMOOTHING, SPLIT_YEAR

OBS = """obs AS (
  SELECT l_returnflag AS survey, l_orderkey AS sample_id,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
         l_suppkey AS station, l_partkey AS taxon, l_quantity AS cpue
  FROM lineitem)"""
NAMED = OBS + """, named AS (
  SELECT obs.*, p_name AS taxon_name, p_type AS grp FROM obs LEFT JOIN part ON p_partkey = taxon)"""
REGIONS = """regions AS (
  SELECT s_suppkey AS station, r_name AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SEASON = """CASE WHEN month BETWEEN 3 AND 5 THEN 'Spring' WHEN month BETWEEN 6 AND 8 THEN 'Summer'
  WHEN month BETWEEN 9 AND 11 THEN 'Fall' ELSE 'Winter' END"""
FISH = "grp IN ('SMALL', 'STANDARD')"
ORDERS = """ord AS (
  SELECT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         o_totalprice / 100 AS price, o_orderstatus AS status FROM orders)"""


# Queries with a date column, which is compared as text.
DATED = frozenset(
    """monthly_richness fish_richness present_richness monthly_shannon monthly_simpson regional_richness regional_taxa
    regional_shannon composition_filled composition_sparse composition_wide monthly_environment daily_environment mean_line covariate_join
    deviance_residuals fixed_gam_residuals""".split()
)


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def calendar(source: str, keys: list[str], columns: str, date: str = "date", step: str = "month") -> str:
    """Fill the gaps of ``source`` between the first and last date of each key."""
    k = ", ".join(keys)
    group = f"GROUP BY {k}" if keys else ""
    lead = f"{k}, " if keys else ""
    using = ", ".join([*keys, date])
    return f"""SELECT {lead}{date}, {columns} FROM (
  SELECT {lead}CAST(unnest(generate_series(min({date}), max({date}), INTERVAL 1 {step})) AS DATE) AS {date}
  FROM {source} {group}) LEFT JOIN {source} USING ({using})"""


def diversity(source: str, keys: str, taxon: str = "taxon") -> str:
    """Totals and both indices from shares, not from the one-pass identity."""
    return f"""n AS (SELECT {keys}, {taxon}, sum(cpue) AS n FROM {source} GROUP BY {keys}, {taxon}),
p AS (SELECT {keys}, n, n / sum(n) OVER (PARTITION BY {keys}) AS p FROM n),
div AS (SELECT {keys}, sum(n) AS total, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS shannon,
               1 - sum(p * p) AS simpson FROM p GROUP BY {keys})"""


#: Number of years of the supplied dates.
YEARS = 7

SERIES = (
    f"{OBS}, {ORDERS}, {diversity('obs', 'date')}, rich AS (SELECT date, count(DISTINCT taxon) AS richness FROM obs GROUP BY date), "
    "prices AS (SELECT date, avg(price) / 1000 AS price FROM ord GROUP BY date), "
    "series AS (SELECT date, richness, shannon, total, price, CAST(year(date) AS INTEGER) AS year, "
    "CAST(month(date) AS INTEGER) AS month FROM rich JOIN div USING (date) JOIN prices USING (date))"
)
SURVEY = (
    f"{OBS}, sr AS (SELECT survey, date, year, month, count(DISTINCT taxon) AS richness "
    "FROM obs GROUP BY survey, date, year, month)"
)

SAMPLES = "samples AS (SELECT DISTINCT year, station FROM obs)"
CURVE = f"""{OBS}, {SAMPLES},
ranks AS (
  SELECT year, station, perm, row_number() OVER (PARTITION BY year, perm
           ORDER BY md5(concat_ws('-', CAST(station AS VARCHAR), CAST(perm AS VARCHAR), '{SEED}'))) AS k
  FROM samples, generate_series(1, {PERMUTATIONS}) g(perm)),
firsts AS (
  SELECT year, perm, taxon, min(k) AS k
  FROM (SELECT year, station, taxon FROM obs GROUP BY year, station, taxon HAVING sum(cpue) > 0)
  JOIN ranks USING (year, station) GROUP BY year, perm, taxon),
steps AS (SELECT year, perm, k, count(*) AS found FROM firsts GROUP BY year, perm, k),
totals AS (
  SELECT year, perm, k, sum(coalesce(found, 0)) OVER (PARTITION BY year, perm ORDER BY k) AS richness
  FROM ranks LEFT JOIN steps USING (year, perm, k)),
curve AS (SELECT year, k, avg(richness) AS richness FROM totals GROUP BY year, k)"""
SLOPES = f"""{CURVE},
slopes AS (
  SELECT year, regr_slope(richness, ln(k)) AS slope,
         sqrt((regr_syy(richness, ln(k)) - regr_slope(richness, ln(k)) * regr_sxy(richness, ln(k)))
              / (count(*) - 2) / regr_sxx(richness, ln(k))) AS se,
         regr_r2(richness, ln(k)) AS r2, count(*) AS n
  FROM curve GROUP BY year)"""

TRAITS = """traits AS (
  SELECT p_name AS taxon_name, avg(p_size) AS trophic_level, avg(p_retailprice) AS temp_mean,
         min(p_retailprice) AS lower_lat, max(p_retailprice) AS upper_lat FROM part GROUP BY p_name),
yearly AS (SELECT DISTINCT year, taxon_name FROM named),
matched AS (
  SELECT *, upper_lat - (upper_lat - lower_lat) / 2 AS mid_lat FROM yearly LEFT JOIN traits USING (taxon_name))"""
LENGTHS = """lengths AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_partkey AS taxon, l_extendedprice / 100 AS length,
         l_linenumber AS freq, p_name AS taxon_name, p_type AS grp
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def mean_se(source: str, column: str, name: str | None = None) -> str:
    return (
        f"SELECT year, '{name or column}' AS trait, avg({column}) AS mean, "
        f"stddev_samp({column}) / sqrt(count(*)) AS se, count(*) AS n FROM {source} GROUP BY year"
    )


def lengths_by(taxon: str) -> str:
    return (
        f"stage AS (SELECT year, {taxon}, sum(length * freq) / sum(freq) AS length FROM lengths "
        f"WHERE length < 999 AND {FISH} GROUP BY year, {taxon})"
    )


ERF = "(SELECT 2 / sqrt(pi()) * sum((1 - 2 * (i % 2)) * exp((2 * i + 1) * ln({x}) - lgamma(i + 1)) / (2 * i + 1)) FROM generate_series(0, 120) g(i))"


def normal_p(z: str) -> str:
    """Two-sided tail by the error function's series."""
    series = ERF.format(x=f"(abs({z}) / sqrt(2))")
    # beyond 6 the tail is under the digits kept, and the series loses its own
    return f"CASE WHEN {z} = 0 THEN 1.0 WHEN abs({z}) > 6 THEN 0.0 ELSE 1 - {series} END"


def student_p(t: str, v: str) -> str:
    """Two-sided tail by Simpson's rule on the density from 0 to |t|."""
    f = f"pow(1 + pow(abs({t}) * i / 4000.0, 2) / {v}, -({v} + 1) / 2.0)"
    weight = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    norm = f"exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi())"
    return f"1 - 2 * {norm} * abs({t}) / 12000.0 * (SELECT sum({weight} * {f}) FROM generate_series(0, 4000) g(i))"


def kendall(source: str, groups: str, keys: str, time: str, value: str, continuity: bool) -> str:
    """All pairs, ties by value, summed over the groups of a key."""
    shift = "s - sign(s)" if continuity else "s"
    on = " AND ".join(f"a.{g.strip()} = b.{g.strip()}" for g in groups.split(","))
    first = ", ".join(f"a.{g.strip()}" for g in groups.split(","))
    return f"""pairs AS (
  SELECT {first}, sum(CASE WHEN a.{time} < b.{time} THEN sign(b.{value} - a.{value}) ELSE 0 END) AS s
  FROM {source} a JOIN {source} b ON {on} GROUP BY ALL),
tied AS (SELECT {groups}, {value}, CAST(count(*) AS DOUBLE) AS c FROM {source} GROUP BY {groups}, {value}),
ties AS (
  SELECT {groups}, sum(c) AS n, sum(c * (c - 1) / 2) AS t2, sum(c * (c - 1) * (2 * c + 5)) AS t5
  FROM tied GROUP BY {groups}),
parts AS (
  SELECT {groups}, n, s, (n * (n - 1) * (2 * n + 5) - t5) / 18 AS var_s,
         sqrt(n * (n - 1) / 2 * (n * (n - 1) / 2 - t2)) AS d FROM ties JOIN pairs USING ({groups})),
tests AS (
  SELECT {keys}, sum(n) AS n, sum(s) AS s, sum(var_s) AS var_s, sum(d) AS d FROM parts GROUP BY {keys}),
scored AS (
  SELECT *, s / CASE WHEN d > 0 THEN d END AS tau,
         ({shift}) / CASE WHEN var_s > 0 THEN sqrt(var_s) END AS z FROM tests)
SELECT {keys}, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, {r('var_s')} AS var_s, {r('tau')} AS tau,
       {r('z')} AS z, {r(normal_p('z'))} AS p FROM scored"""


def lagged(source: str, keys: str, x: str, y: str, lags: int, position: str) -> str:
    lead = f"{keys}, " if keys else ""
    over = f"PARTITION BY {keys}" if keys else ""
    on = f"a.{keys} = b.{keys} AND " if keys else ""
    pick = f"a.{keys}, " if keys else ""
    using = f"{keys}, lag" if keys else "lag"
    group = f"GROUP BY {keys}" if keys else ""
    return f"""pos AS (SELECT {lead}{position} AS t, {x} AS x, {y} AS y FROM {source}),
centred AS (
  SELECT {lead}t, x - avg(x) OVER ({over}) AS dx, y - avg(y) OVER ({over}) AS dy FROM pos),
stats AS (SELECT {lead}stddev_pop(x) AS sx, stddev_pop(y) AS sy, count(*) AS n FROM pos {group}),
sums AS (
  SELECT {pick}a.t - b.t AS lag, sum(a.dx * b.dy) AS c FROM centred a JOIN centred b
  ON {on}abs(a.t - b.t) <= {lags} GROUP BY ALL),
lags AS (SELECT *, CAST(unnest(generate_series(-least({lags}, n - 1), least({lags}, n - 1))) AS INTEGER) AS lag FROM stats)
SELECT {lead}CAST(lag AS INTEGER) AS lag, {r('coalesce(c, 0) / (n * sx * sy)')} AS r FROM lags LEFT JOIN sums USING ({using})"""


DAYS = "date_diff('day', DATE '1970-01-01', date)"
MONTHS = "(year(date) * 12 + month(date))"


def poisson_steps(source: str, a: str, b: str, name: str = "fit", steps: int = 12) -> str:
    """Newton steps for a two-covariate Poisson model as a chain of CTEs.

    ``a`` and ``b`` are centred first; the last step is expanded back.
    """
    out = [
        f"{name}_c AS (SELECT avg({a}) AS ma, avg({b}) AS mb, ln(avg(richness)) AS l FROM {source})",
        f"{name}_d AS (SELECT {a} - ma AS a, {b} - mb AS b, CAST(richness AS DOUBLE) AS y FROM {source}, {name}_c)",
        f"{name}_0 AS (SELECT l AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 FROM {name}_c)",
    ]
    for i in range(steps):
        out.append(
            f"{name}_h{i} AS (SELECT b0, b1, b2, sum(m) AS s0, sum(m*a) AS sa, sum(m*b) AS sb, sum(m*a*a) AS saa, "
            f"sum(m*a*b) AS sab, sum(m*b*b) AS sbb, sum(y-m) AS g0, sum((y-m)*a) AS ga, sum((y-m)*b) AS gb FROM "
            f"(SELECT *, exp(b0 + b1*a + b2*b) AS m FROM {name}_d, {name}_{i}) GROUP BY b0, b1, b2)"
        )
        out.append(
            f"{name}_v{i} AS (SELECT *, s0*(saa*sbb-sab*sab) - sa*(sa*sbb-sab*sb) + sb*(sa*sab-saa*sb) AS det FROM {name}_h{i})"
        )
        out.append(
            f"{name}_{i + 1} AS (SELECT b0 + ((saa*sbb-sab*sab)*g0 + (sb*sab-sa*sbb)*ga + (sa*sab-saa*sb)*gb)/det AS b0, "
            f"b1 + ((sb*sab-sa*sbb)*g0 + (s0*sbb-sb*sb)*ga + (sa*sb-s0*sab)*gb)/det AS b1, "
            f"b2 + ((sa*sab-saa*sb)*g0 + (sa*sb-s0*sab)*ga + (s0*saa-sa*sa)*gb)/det AS b2 FROM {name}_v{i})"
        )
    last = f"{name}_v{steps - 1}"
    out.append(
        f"{name} AS (SELECT b0 - b1*ma - b2*mb AS b0, b1, b2, "
        f"sqrt(((saa*sbb-sab*sab) + ma*ma*(s0*sbb-sb*sb) + mb*mb*(s0*saa-sa*sa) - 2*ma*(sb*sab-sa*sbb) "
        f"- 2*mb*(sa*sab-saa*sb) + 2*ma*mb*(sa*sb-s0*sab))/det) AS e0, "
        f"sqrt((s0*sbb-sb*sb)/det) AS e1, sqrt((s0*saa-sa*sa)/det) AS e2 FROM {last}, {name}_c)"
    )
    return ", ".join(out)


def poisson_terms(name: str, model: str, a: str, b: str, digits: int = 5) -> str:
    rows = (("(Intercept)", 0), (a, 1), (b, 2))
    return " UNION ALL ".join(
        f"SELECT '{model}' AS model_id, '{label}' AS term, {r(f'b{i}', digits)} AS estimate, "
        f"{r(f'e{i}', digits)} AS std_error, {r(f'b{i} / e{i}', 3)} AS z, {r(normal_p(f'(b{i} / e{i})'))} AS p FROM {name}"
        for label, i in rows
    )


def eliminated(source: str, keep: str, size: int, sides: int) -> str:
    """Solve symmetric systems row by row: columns a{i}_{j} (i <= j) and right sides g{i}_{k} give s{i}_{k}."""
    rest = lambda p: ", ".join(
        [f"a{i}_{j}" for i in range(p + 1) for j in range(i, size)] + [f"g{i}_{k}" for i in range(p + 1) for k in range(sides)]
    )
    for p in range(size - 1):
        rows = [
            f"a{i}_{j} - a{p}_{i} * a{p}_{j} / a{p}_{p} AS a{i}_{j}" for i in range(p + 1, size) for j in range(i, size)
        ] + [f"g{i}_{k} - a{p}_{i} * g{p}_{k} / a{p}_{p} AS g{i}_{k}" for i in range(p + 1, size) for k in range(sides)]
        source = f"(SELECT {keep}, {rest(p)}, {', '.join(rows)} FROM {source})"
    for i in reversed(range(size)):
        found = [
            f"(g{i}_{k}{''.join(f' - a{i}_{j} * s{j}_{k}' for j in range(i + 1, size))}) / a{i}_{i} AS s{i}_{k}" for k in range(sides)
        ]
        source = f"(SELECT *, {', '.join(found)} FROM {source})"
    return source


def all_subsets(terms: dict[str, list[str]], steps: int = 9) -> str:
    """Poisson fits of every subset of terms: Newton steps of all models in one recursive query.

    Columns outside a model get a unit row, so that all systems have one size.
    Gives ``ranked`` (the models in order) and ``est`` (raw coefficients and variances).
    """
    columns = [c for cs in terms.values() for c in cs]
    size = len(columns) + 1
    models = []
    for n in range(len(terms) + 1):
        for chosen in itertools.combinations(terms, n):
            flags = [str(int(any(c in terms[t] for t in chosen))) for c in columns]
            models.append(f"('{' + '.join(chosen) or '1'}', {', '.join(flags)})")
    k = ["1"] + [f"k{i}" for i in range(1, size)]
    x = ["1"] + [f"x{i}" for i in range(1, size)]
    b = [f"b{i}" for i in range(size)]
    flags, eta = ", ".join(k[1:]), " + ".join(f"b{i} * {x[i]}" for i in range(size))
    gram = [
        f"{k[i]} * {k[j]} * sum(m * {x[i]} * {x[j]})" + (f" + 1 - {k[i]}" if i == j else "") + f" AS a{i}_{j}"
        for i in range(size)
        for j in range(i, size)
    ]
    slopes = [f"{k[i]} * sum((y - m) * {x[i]}) AS g{i}_0" for i in range(size)]
    keep = f"name, {flags}, step, {', '.join(b)}"

    def sums(sides: list[str], at: str) -> str:
        return f"(SELECT {keep}, {', '.join([*gram, *sides])} FROM (SELECT *, exp({eta}) AS m FROM d, fit WHERE {at}) GROUP BY {keep})"

    step = eliminated(sums(slopes, f"step < {steps}"), keep, size, 1)
    # right sides of the variances: the raw intercept's weights, then each column alone
    unit = [f"{k[i]} * {'1' if i == 0 else f'(0 - c{i})'} AS g{i}_0" for i in range(size)] + [
        f"CAST({int(i == j)} AS DOUBLE) * {k[i]} AS g{i}_{j}" for i in range(size) for j in range(1, size)
    ]
    last = f"(SELECT * FROM fit WHERE step = {steps})"
    gram_at_end = f"(SELECT {keep}, {', '.join(gram)} FROM (SELECT *, exp({eta}) AS m FROM d, {last}) GROUP BY {keep})"
    inverse = eliminated(f"(SELECT {keep}, {', '.join(f'a{i}_{j}' for i in range(size) for j in range(i, size))}, {', '.join(unit)} FROM {gram_at_end}, c)", keep, size, size)
    raw0 = "b0" + "".join(f" - b{i} * c{i}" for i in range(1, size))
    var0 = "s0_0" + "".join(f" - k{i} * c{i} * s{i}_0" for i in range(1, size))
    est = [f"SELECT name, '(Intercept)' AS term, {raw0} AS b, {var0} AS v, 0 AS place FROM inv, c"] + [
        f"SELECT name, '{column}', b{i}, s{i}_{i}, {i} FROM inv WHERE k{i} = 1" for i, column in enumerate(columns, 1)
    ]
    waves = {"cosine": "cos(2 * pi() * month / 10)", "sine": "sin(2 * pi() * month / 10)"}
    value = [waves.get(c, c) for c in columns]
    edf = " + ".join(k)
    return f"""c AS (SELECT {', '.join(f'avg({v}) AS c{i}' for i, v in enumerate(value, 1))} FROM series),
d AS (SELECT CAST(richness AS DOUBLE) AS y, {', '.join(f'{v} - c{i} AS x{i}' for i, v in enumerate(value, 1))} FROM series, c),
models(name, {flags}) AS (VALUES {', '.join(models)}),
fit AS (
  SELECT name, {flags}, 0 AS step, (SELECT ln(avg(y)) FROM d) AS b0, {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' for i in range(1, size))} FROM models
  UNION ALL
  SELECT name, {flags}, step + 1, {', '.join(f'b{i} + s{i}_0' for i in range(size))} FROM {step}),
inv AS (SELECT * FROM {inverse}),
est AS ({' UNION ALL '.join(est)}),
worth AS (SELECT name, {edf} AS edf,
    sum(2 * (CASE WHEN y > 0 THEN y * ln(y / m) ELSE 0 END - (y - m))) AS deviance,
    -2 * sum(y * ln(m) - m - lgamma(y + 1)) + 2 * ({edf}) AS aic
  FROM (SELECT *, exp({eta}) AS m FROM d, {last}) GROUP BY name, {flags}),
weighed AS (SELECT *, aic - min(aic) OVER () AS delta, exp(-(aic - min(aic) OVER ()) / 2) AS raw FROM worth),
shares AS (SELECT *, raw / sum(raw) OVER () AS weight, row_number() OVER (ORDER BY aic, name) AS rank FROM weighed),
ranked AS (SELECT *, sum(weight) OVER (ORDER BY rank) AS cumulative, sum(weight) OVER (ORDER BY rank) - weight < 0.95 AS in_set FROM shares)"""


def month_splines(knots: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Values in months 1 to 12 of the periodic cubic splines that are 1 at one knot, and their penalty.

    From the definition: piecewise cubic, twice continuously differentiable,
    knots evenly from 1 to 12, which are one point.
    """
    n, h = knots - 1, 11 / (knots - 1)
    turn = np.roll(np.eye(n), 1, axis=1)  # to the next knot
    bend = np.linalg.solve((turn + turn.T) * h / 6 + np.eye(n) * 2 * h / 3, (turn + turn.T - 2 * np.eye(n)) / h)
    values = []
    for month in range(1, 13):
        at = (month - 1) % 11 / h
        i = int(at)
        right = at - i
        left = 1 - right
        ends = left * np.eye(n)[i % n] + right * np.eye(n)[(i + 1) % n]
        values.append(ends + h * h / 6 * ((left**3 - left) * bend[i % n] + (right**3 - right) * bend[(i + 1) % n]))
    return np.array(values), (turn + turn.T - 2 * np.eye(n)) / h @ bend


def penalised(
    smoothing: float, linear: tuple[str, ...], steps: int = 12, splines: tuple[np.ndarray, np.ndarray] | None = None
) -> str:
    """Penalised Poisson fit of linear terms and a smooth of the month, cyclic unless given; the smooth has the intercept in it."""
    values, penalty = splines or month_splines()
    n, m = len(linear), values.shape[1]
    size = n + m
    x = [f"x{i}" for i in range(size)]
    b = ", ".join(f"b{i}" for i in range(size))
    eta = " + ".join(f"b{i} * x{i}" for i in range(size))
    s = lambda i, j: float(smoothing * penalty[i - n, j - n]) if i >= n and j >= n else 0.0
    gram = ", ".join(f"sum(m * {x[i]} * {x[j]}) + ({s(i, j)!r}) AS a{i}_{j}" for i in range(size) for j in range(i, size))
    pull = lambda i: "".join(f" - ({s(i, j)!r}) * b{j}" for j in range(n, size)) if i >= n else ""
    slopes = ", ".join(f"sum((y - m) * {x[i]}){pull(i)} AS g{i}_0" for i in range(size))
    means = ", ".join(f"avg(x{i}) AS m{i}" for i in range(size))
    rows = "(SELECT *, exp({eta}) AS m FROM d, {fit})"
    step = eliminated(f"(SELECT step, {b}, {gram}, {slopes} FROM {rows.format(eta=eta, fit=f'(SELECT * FROM fit WHERE step < {steps})')} GROUP BY step, {b})", f"step, {b}", size, 1)
    # right sides: the intercept's weights, the linear terms, the penalty's columns
    start = [f"{'-c%d' % i if i < n else f'm{i}'} AS g{i}_0" for i in range(size)]
    unit = [f"{float(i == j)!r} AS g{i}_{j + 1}" for i in range(size) for j in range(n)]
    back = [f"({s(i, j)!r}) AS g{i}_{j + 1}" for i in range(size) for j in range(n, size)]
    at_end = f"(SELECT {b}, {gram} FROM {rows.format(eta=eta, fit='last')} GROUP BY {b})"
    whole = f"(SELECT * EXCLUDE ({b}), {', '.join(start + unit + back)} FROM {at_end}, mean, c)"
    solved = eliminated(whole, ", ".join(f"c{i}" for i in range(n)) + ", " + ", ".join(f"m{i}" for i in range(size)), size, size + 1)
    base = " + ".join(f"b{i} * m{i}" for i in range(n, size)) + "".join(f" - b{i} * c{i}" for i in range(n))
    base_v = " + ".join(f"m{i} * s{i}_0" for i in range(n, size)) + "".join(f" - c{i} * s{i}_0" for i in range(n))
    lost = " + ".join(f"s{i}_{i + 1}" for i in range(n, size))
    terms = [f"SELECT '(Intercept)' AS term, {base} AS b, sqrt({base_v}) AS e, 1.0 AS edf FROM last, inv"] + [
        f"SELECT '{t}', b{i}, sqrt(s{i}_{i + 1}), 1.0 FROM last, inv" for i, t in enumerate(linear)
    ]
    table = ", ".join(f"({k + 1}, {', '.join(repr(float(v)) for v in row)})" for k, row in enumerate(values))
    return f"""basis(of_month, {', '.join(f'z{i}' for i in range(m))}) AS (VALUES {table}),
c AS (SELECT {', '.join(f'avg({t}) AS c{i}' for i, t in enumerate(linear))} FROM series),
d AS (SELECT date, CAST(richness AS DOUBLE) AS y, {', '.join(f'{t} - c{i} AS x{i}' for i, t in enumerate(linear))},
  {', '.join(f'CAST(z{i} AS DOUBLE) AS x{n + i}' for i in range(m))} FROM series JOIN basis ON of_month = month, c),
mean AS (SELECT {means} FROM d),
fit AS (
  SELECT 0 AS step, {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' if i < n else f'ln(avg(y)) AS b{i}' for i in range(size))} FROM d
  UNION ALL SELECT step + 1, {', '.join(f'b{i} + s{i}_0' for i in range(size))} FROM {step}),
last AS (SELECT * FROM fit WHERE step = {steps}),
inv AS (SELECT *, {size} - ({lost}) AS edf FROM {solved}),
terms AS ({' UNION ALL '.join(terms)}),
mu AS (SELECT date, y AS richness, exp({eta}) AS fit FROM d, last)"""


def natural_splines(knots: int) -> tuple[np.ndarray, np.ndarray]:
    """Values in months 1 to 12 of the natural cubic splines that are 1 at one of the even knots from 1 to 12, and their penalty."""
    h = 11 / (knots - 1)
    ones = np.eye(knots)
    # curvatures at the knots: none at the ends, and slopes meet at the others
    meet = np.zeros((knots, knots))
    right = np.zeros((knots, knots))
    meet[0, 0] = meet[-1, -1] = 1
    for i in range(1, knots - 1):
        meet[i, i - 1 : i + 2] = h / 6, 2 * h / 3, h / 6
        right[i] = (ones[i - 1] - 2 * ones[i] + ones[i + 1]) / h
    bend = np.linalg.solve(meet, right)
    values = []
    for month in range(1, 13):
        i = min(int((month - 1) / h), knots - 2)
        b = (month - 1) / h - i
        a = 1 - b
        values.append(a * ones[i] + b * ones[i + 1] + h * h / 6 * ((a**3 - a) * bend[i] + (b**3 - b) * bend[i + 1]))
    # the squared curvature is piecewise linear squared
    mass = np.zeros((knots, knots))
    for i in range(knots - 1):
        mass[i : i + 2, i : i + 2] += h / 6 * np.array([[2, 1], [1, 2]])
    return np.array(values), bend.T @ mass @ bend


def month_smooth(smoothing: float) -> str:
    """Penalised least squares of richness on the month; s{i}_0 are the coefficients, then those of the penalty's columns and of each month."""
    values, penalty = natural_splines(SMOOTH_KNOTS)
    m = values.shape[1]
    table = ", ".join(f"({k + 1}, {', '.join(repr(float(v)) for v in row)})" for k, row in enumerate(values))
    gram = ", ".join(f"sum(CAST(z{i} AS DOUBLE) * z{j}) + ({float(smoothing * penalty[i, j])!r}) AS a{i}_{j}" for i in range(m) for j in range(i, m))
    sides = [f"sum(CAST(z{i} AS DOUBLE) * richness) AS g{i}_0" for i in range(m)]
    sides += [f"({float(smoothing * penalty[i, j])!r}) AS g{i}_{j + 1}" for i in range(m) for j in range(m)]
    sides += [f"({float(values[k, i])!r}) AS g{i}_{m + 1 + k}" for i in range(m) for k in range(12)]
    source = f"(SELECT count(*) AS n, {gram}, {', '.join(sides)} FROM series JOIN basis ON of_month = month)"
    solved = eliminated(source, "n", m, m + 13)
    lost = " + ".join(f"s{i}_{i + 1}" for i in range(m))
    at = lambda k, c: " + ".join(f"({float(values[k, i])!r}) * s{i}_{c(k)}" for i in range(m))
    rows = " UNION ALL ".join(f"SELECT {k + 1} AS month, {at(k, lambda _: 0)} AS fit, {at(k, lambda k: m + 1 + k)} AS v FROM solved" for k in range(12))
    return f"""basis(of_month, {', '.join(f'z{i}' for i in range(m))}) AS (VALUES {table}),
solved AS (SELECT *, {m} - ({lost}) AS edf FROM {solved}),
months AS ({rows}),
sums AS (SELECT count(*) AS n, sum(pow(richness - fit, 2)) AS rss, var_pop(richness) * count(*) AS yy FROM series JOIN months USING (month)),
scaled AS (SELECT sums.n, rss, yy, edf, rss / (sums.n - edf) AS scale FROM sums, solved)"""


DEVIANCE = "2 * (CASE WHEN richness > 0 THEN richness * ln(richness / fit) ELSE 0 END - (richness - fit))"


def kernel(source: str, column: str, points: int, digits: int, x_digits: int) -> str:
    return f"""bw AS (
  SELECT year, CAST(count(*) AS DOUBLE) AS n, 0.9 * least(stddev_samp({column}),
    (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) / 1.34) * pow(count(*), -0.2) AS b
  FROM {source} GROUP BY year),
grid AS (SELECT b, lo - 3 * b AS start, (hi - lo + 6 * b) / {points - 1} AS step FROM (
  SELECT (SELECT avg(b) FROM bw) AS b, min({column}) AS lo, max({column}) AS hi FROM {source})),
dens AS (
  SELECT year, k, any_value(start + step * k) AS x,
         sum(exp(-pow((start + step * k - {column}) / b, 2) / 2)) / (count(*) * any_value(b) * sqrt(2 * pi())) AS v
  FROM {source}, grid, generate_series(0, {points - 1}) g(k) GROUP BY year, k)
SELECT year, {r('x', x_digits)} AS x, {r('v', digits)} AS value FROM dens"""


def loess(source: str, key: str, x: str, points: int, digits: int) -> str:
    """The local fits from their definition: every row against every grid point."""
    return f"""ls AS (SELECT {key} AS key, CAST({x} AS DOUBLE) AS x, CAST(richness AS DOUBLE) AS y FROM {source}),
ends AS (SELECT key, min(x) AS lo, max(x) AS hi, greatest(floor(count(*) * 0.75 + 0.00001), 1) AS q FROM ls GROUP BY key),
placed AS (
  SELECT ls.key, k, lo + (hi - lo) * (k / {points - 1}.0) AS g, x, y, q
  FROM ls JOIN ends ON ls.key = ends.key, generate_series(0, {points - 1}) t(k)),
near AS (SELECT *, row_number() OVER (PARTITION BY key, k ORDER BY abs(x - g)) AS rn FROM placed),
widths AS (SELECT key, k, max(CASE WHEN rn = q THEN abs(x - g) END) AS h FROM near GROUP BY key, k),
u AS (
  SELECT key, k, g, y, (x - g) / h AS u, pow(1 - pow(abs((x - g) / h), 3), 3) AS w
  FROM placed JOIN widths USING (key, k) WHERE abs((x - g) / h) < 1),
m AS (
  SELECT key, k, any_value(g) AS g, sum(w) AS s0, sum(w*u) AS s1, sum(w*u*u) AS s2, sum(w*u*u*u) AS s3,
         sum(w*u*u*u*u) AS s4, sum(w*y) AS t0, sum(w*y*u) AS t1, sum(w*y*u*u) AS t2 FROM u GROUP BY key, k),
fitted AS (
  SELECT key, g, (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2))
         / (s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2)) AS v FROM m)"""


def loess_errors(points: int) -> str:
    """Errors of the lines between local fits, from the whole matrix of the smoother."""
    return f"""ls AS (SELECT row_number() OVER (ORDER BY date) AS i, CAST(price AS DOUBLE) AS x, CAST(richness AS DOUBLE) AS y FROM series),
ends AS (SELECT min(x) AS lo, max(x) AS hi, greatest(floor(count(*) * 0.75 + 0.00001), 1) AS q FROM ls),
placed AS (SELECT i, k, lo + (hi - lo) * (k / {points - 1}.0) AS g, x, y, q FROM ls, ends, generate_series(0, {points - 1}) t(k)),
near AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(x - g)) AS rn FROM placed),
widths AS (SELECT k, max(CASE WHEN rn = q THEN abs(x - g) END) AS h FROM near GROUP BY k),
u AS (
  SELECT i, k, g, y, (x - g) / h AS u, pow(1 - pow(abs((x - g) / h), 3), 3) AS w
  FROM placed JOIN widths USING (k) WHERE abs((x - g) / h) < 1),
m AS (
  SELECT k, sum(w) AS s0, sum(w*u) AS s1, sum(w*u*u) AS s2, sum(w*u*u*u) AS s3, sum(w*u*u*u*u) AS s4 FROM u GROUP BY k),
v AS (
  SELECT k, g, i, y, w * ((s2*s4-s3*s3) - (s1*s4-s2*s3) * u + (s1*s3-s2*s2) * u * u)
         / (s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2)) AS v FROM u JOIN m USING (k)),
fits AS (SELECT k, any_value(g) AS x, sum(v * y) AS fit, sum(v * v) AS vv FROM v GROUP BY k),
spot AS (SELECT i, (x - lo) / (hi - lo) * {points - 1} AS spot_at, least(floor((x - lo) / (hi - lo) * {points - 1}), {points - 2}) AS k FROM ls, ends),
phi AS (SELECT i, k, 1 - (spot_at - k) AS p FROM spot UNION ALL SELECT i, k + 1, spot_at - k FROM spot),
l AS (SELECT phi.i, v.i AS j, sum(p * v) AS l FROM phi JOIN v USING (k) GROUP BY ALL),
rest AS (
  SELECT a.i, b.i AS j, b.y, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END - coalesce(l, 0) AS e
  FROM ls a CROSS JOIN ls b LEFT JOIN l ON l.i = a.i AND l.j = b.i),
products AS (SELECT a.i, b.i AS j, sum(a.e * b.e) AS a FROM rest a JOIN rest b USING (j) GROUP BY ALL),
deltas AS (SELECT sum(CASE WHEN i = j THEN a END) AS one, sum(a * a) AS two FROM products),
residual AS (SELECT sum(e * e) AS rr FROM (SELECT i, sum(e * y) AS e FROM rest GROUP BY i))"""


def kendall_orders(source: str, key: str, season: str, value: str, date: str) -> str:
    """S of every order of every season's values, and their sums over twelve seasons."""
    sums = ",\n".join(
        f"c{m} AS (SELECT {key}, a.s + b.s AS s, sum(a.p * b.p) AS p FROM c{m - 1} a JOIN "
        f"(SELECT * FROM padded WHERE {season} = {m}) b USING ({key}) GROUP BY ALL)"
        for m in range(2, 13)
    )
    return f"""vs AS (SELECT {key}, {season}, list({value} ORDER BY {date}) AS v, count(*) AS n FROM {source} GROUP BY ALL),
perm AS (
  SELECT n, CAST([] AS BIGINT[]) AS p FROM (SELECT DISTINCT n FROM vs)
  UNION ALL SELECT n, list_append(p, i) FROM perm, generate_series(1, {YEARS}) t(i)
  WHERE i <= n AND len(p) < n AND NOT list_contains(p, i)),
pairs AS (SELECT i, j FROM generate_series(1, {YEARS}) a(i), generate_series(1, {YEARS}) b(j) WHERE i < j),
orders AS (
  SELECT {key}, {season}, p, coalesce(sum(sign(v[p[j]] - v[p[i]])), 0) AS s
  FROM vs JOIN perm ON vs.n = perm.n AND len(p) = vs.n LEFT JOIN pairs ON j <= vs.n GROUP BY ALL),
dist AS (
  SELECT {key}, {season}, s, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY {key}, {season}) AS p
  FROM orders GROUP BY {key}, {season}, s),
padded AS (
  SELECT * FROM dist
  UNION ALL SELECT {key}, m, 0, 1.0 FROM (SELECT DISTINCT {key} FROM vs) k, generate_series(1, 12) t(m)
  WHERE NOT EXISTS (SELECT 1 FROM vs WHERE vs.{key} = k.{key} AND vs.{season} = m)),
c1 AS (SELECT {key}, s, p FROM padded WHERE {season} = 1),
{sums},
seen AS (
  SELECT {key}, sum(CASE WHEN j IS NULL THEN 0 ELSE sign(v[j] - v[i]) END) AS s
  FROM vs LEFT JOIN pairs ON j <= vs.n GROUP BY {key}),
sizes AS (SELECT {key}, count(*) AS n FROM {source} GROUP BY {key})"""


def _oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    rich = "rich AS (SELECT date, count(DISTINCT taxon) AS richness FROM {} GROUP BY date)"
    q["monthly_richness"] = f"WITH {OBS}, {rich.format('obs')} " + calendar("rich", [], "richness")
    q["seasonal_richness"] = (
        f"WITH {OBS} SELECT year, {SEASON} AS season, count(DISTINCT taxon) AS richness FROM obs GROUP BY ALL"
    )
    q["fish_richness"] = (
        f"WITH {NAMED}, caught AS (SELECT * FROM named WHERE {FISH}), {rich.format('caught')} "
        + calendar("rich", [], "richness")
    )
    q["present_richness"] = (
        f"WITH {OBS}, t AS (SELECT survey, date, taxon FROM obs GROUP BY ALL HAVING sum(cpue) > 40), "
        "rich AS (SELECT survey, date, count(*) AS richness FROM t GROUP BY ALL) "
        + calendar("rich", ["survey"], "richness")
    )
    q["monthly_shannon"] = (
        f"WITH {OBS}, {diversity('obs', 'date')} "
        + calendar("div", [], f"{r('total')} AS total, {r('shannon')} AS shannon")
    )
    q["monthly_simpson"] = (
        f"WITH {OBS}, {diversity('obs', 'survey, date')} "
        + calendar("div", ["survey"], f"{r('simpson', 8)} AS simpson")
    )
    q["seasonal_shannon"] = (
        f"WITH {OBS}, seasonal AS (SELECT *, {SEASON} AS season FROM obs), "
        f"{diversity('seasonal', 'year, season')} SELECT year, season, {r('shannon')} AS shannon FROM div"
    )
    q["regional_richness"] = (
        f"WITH {OBS}, {REGIONS}, rich AS (SELECT region, date, count(DISTINCT (station, taxon)) AS richness "
        "FROM obs JOIN regions USING (station) GROUP BY ALL) " + calendar("rich", ["region"], "richness")
    )
    q["regional_taxa"] = (
        f"WITH {OBS}, {REGIONS}, rich AS (SELECT region, date, count(DISTINCT taxon) AS richness "
        "FROM obs JOIN regions USING (station) GROUP BY ALL) "
        "SELECT * FROM rich WHERE date IN (SELECT date FROM rich WHERE region = 'ASIA')"
    )
    q["regional_shannon"] = (
        f"WITH {OBS}, {REGIONS}, placed AS (SELECT * FROM obs JOIN regions USING (station)), "
        f"{diversity('placed', 'region, date')} SELECT region, date, {r('shannon')} AS shannon FROM div"
    )
    q["species_totals"] = f"WITH {NAMED} SELECT year, month, taxon_name, sum(cpue) AS n FROM named GROUP BY ALL"

    def share(keys: str, category: str, digits: int = 8) -> str:
        return f"""c AS (SELECT {keys}, {category}, sum(cpue) AS n FROM named WHERE {category} IS NOT NULL GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT {keys} FROM c), (SELECT DISTINCT {category} FROM c)),
shares AS (SELECT {keys}, {category}, round(coalesce(n, 0) / sum(n) OVER (PARTITION BY {keys}), {digits}) + 0.0 AS share
  FROM grid LEFT JOIN c USING ({keys}, {category}))"""

    q["composition_share"] = f"WITH {NAMED}, {share('survey, year', 'grp')} SELECT * FROM shares"
    q["composition_filled"] = f"WITH {NAMED}, {share('station, date', 'grp')} SELECT * FROM shares"
    q["composition_sparse"] = (
        f"WITH {NAMED}, c AS (SELECT station, date, taxon_name, sum(cpue) AS n FROM named WHERE taxon_name IS NOT NULL GROUP BY ALL) "
        f"SELECT station, date, taxon_name, {r('n / sum(n) OVER (PARTITION BY station, date)', 8)} AS share FROM c"
    )
    wide = ", ".join(
        f"max(CASE WHEN grp = '{g}' THEN share END) AS {g}"
        for g in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    )
    q["composition_wide"] = f"WITH {NAMED}, {share('date', 'grp')} SELECT date, {wide} FROM shares GROUP BY date"

    def occurrence(keys: str) -> str:
        lead = f"{keys}, " if keys else ""
        join = f"JOIN months USING ({keys})" if keys else ", months"
        group = f"GROUP BY {keys}" if keys else ""
        return f"""m AS (SELECT {lead}taxon, date, year, sum(cpue) AS n FROM obs GROUP BY ALL),
months AS (SELECT {lead}count(DISTINCT CASE WHEN year < {SPLIT_YEAR} THEN date END) AS me,
  count(DISTINCT CASE WHEN year >= {SPLIT_YEAR} THEN date END) AS ml FROM obs {group}),
present AS (SELECT {lead}taxon, count(DISTINCT CASE WHEN year < {SPLIT_YEAR} AND n > 0 THEN date END) AS e,
  count(DISTINCT CASE WHEN year >= {SPLIT_YEAR} AND n > 0 THEN date END) AS l FROM m GROUP BY ALL),
props AS (SELECT {lead}taxon, e / me AS pe, l / ml AS pl FROM present {join}),
early AS (SELECT {lead}taxon, pe FROM props WHERE pe > 0.05 AND pe < 0.95),
late AS (SELECT {lead}taxon, pl FROM props WHERE pl > 0.05 AND pl < 0.95),
shift AS (SELECT {lead}taxon, pe AS prop_early, pl AS prop_late, pl - pe AS diff
  FROM early RIGHT JOIN late USING ({lead}taxon))"""

    q["occurrence_shift"] = (
        f"WITH {OBS}, {occurrence('')} SELECT taxon, {r('prop_early', 8)} AS prop_early, "
        f"{r('prop_late', 8)} AS prop_late, {r('diff', 8)} AS diff FROM shift"
    )
    q["occurrence_bars"] = (
        f"WITH {OBS}, {occurrence('survey')} SELECT survey, taxon, {r('diff', 8)} AS diff, 'prop_early' AS variable, "
        f"{r('prop_early', 8)} AS value FROM shift UNION ALL SELECT survey, taxon, {r('diff', 8)}, 'prop_late', "
        f"{r('prop_late', 8)} FROM shift"
    )
    first = "SELECT survey, taxon, min(year) AS year FROM obs GROUP BY ALL"
    counts = f"counts AS (SELECT survey, year, count(*) AS n FROM ({first}) WHERE year > 1995 GROUP BY ALL)"
    q["introductions"] = f"WITH {OBS}, {counts} SELECT * FROM counts"
    last = "SELECT survey, taxon, max(year) AS year FROM obs GROUP BY ALL"
    q["departures"] = f"""WITH {OBS}, counts AS (
  SELECT survey, year, count(*) AS n FROM ({last}) WHERE year < 2001 GROUP BY ALL),
years AS (SELECT survey, CAST(unnest(generate_series(min(year), max(year))) AS INTEGER) AS year FROM counts GROUP BY survey)
SELECT survey, year, coalesce(n, 0) AS n FROM years LEFT JOIN counts USING (survey, year)"""
    q["introduction_rate"] = (
        f"WITH {OBS}, counts AS (SELECT survey, year, count(*) AS n FROM ({first}) WHERE year > 1992 GROUP BY ALL) "
        f"SELECT survey, {r('avg(n)')} AS mean, {r('stddev_samp(n)')} AS sd, "
        "count(*) AS years FROM counts WHERE year > 1993 GROUP BY survey"
    )

    q["accumulation_curve"] = f"WITH {CURVE} SELECT year, k, {r('richness')} AS richness FROM curve"
    q["rarefaction_curve"] = f"""WITH {OBS}, {SAMPLES},
sizes AS (SELECT year, count(*) AS n FROM samples GROUP BY year),
found AS (SELECT year, taxon, count(*) AS m FROM (
  SELECT year, station, taxon FROM obs GROUP BY ALL HAVING sum(cpue) > 0) GROUP BY ALL),
line AS (SELECT year, n, unnest(generate_series(1, n)) AS k FROM sizes)
SELECT year, k, {r('''sum(CASE WHEN k > n - m THEN 1 ELSE 1 - exp(lgamma(n - m + 1) - lgamma(n - m - k + 1)
  - lgamma(n + 1) + lgamma(n - k + 1)) END)''', 5)} AS richness FROM line JOIN found USING (year) GROUP BY year, k"""
    q["accumulation_slope"] = (
        f"WITH {SLOPES} SELECT year, {r('slope')} AS slope, {r('se')} AS se, {r('r2')} AS r2, n FROM slopes"
    )
    q["staged_slope"] = f"WITH {SLOPES} SELECT year, {r('slope')} AS slope, n FROM slopes"
    q["slope_quadratic"] = f"""WITH {SLOPES}, c AS (SELECT year, slope AS est, 1 / se AS w, year - avg(year) OVER () AS d FROM slopes),
m AS (SELECT sum(w) AS s0, sum(w*d) AS s1, sum(w*d*d) AS s2, sum(w*d*d*d) AS s3, sum(w*d*d*d*d) AS s4,
  sum(w*est) AS t0, sum(w*est*d) AS t1, sum(w*est*d*d) AS t2 FROM c),
b AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM m)
SELECT year, {r('est', 5)} AS slope, {r('''(t0*(s2*s4-s3*s3) + t1*(s2*s3-s1*s4) + t2*(s1*s3-s2*s2)
  + d*(t0*(s2*s3-s1*s4) + t1*(s0*s4-s2*s2) + t2*(s1*s2-s0*s3))
  + d*d*(t0*(s1*s3-s2*s2) + t1*(s1*s2-s0*s3) + t2*(s0*s2-s1*s1)))/det''', 5)} AS curve FROM c, b"""

    def panel(rows: list[str]) -> str:
        body = " UNION ALL ".join(rows)
        return f"SELECT year, trait, {r('mean')} AS mean, {r('se')} AS se, n FROM ({body})"

    q["trait_trend"] = f"WITH {NAMED}, {TRAITS} " + panel(
        [mean_se("matched", "trophic_level"), mean_se("matched", "temp_mean")]
    )
    lat = [mean_se("matched", c) for c in ("lower_lat", "upper_lat", "mid_lat")]
    q["latitude_trend"] = f"WITH {NAMED}, {TRAITS} " + panel(lat)
    q["length_trend"] = f"WITH {LENGTHS}, {lengths_by('taxon_name')} " + panel([mean_se("stage", "length")])
    q["length_distribution"] = (
        f"WITH {LENGTHS}, {lengths_by('taxon')} SELECT year, taxon, {r('length', 10)} AS length FROM stage"
    )
    q["log_length"] = (
        f"WITH {LENGTHS}, {lengths_by('taxon_name')} SELECT year, {r('avg(ln(length))', 8)} AS mean_log_length "
        "FROM stage GROUP BY year"
    )
    every = " UNION ALL ".join(
        [mean_se("matched", "trophic_level"), mean_se("matched", "temp_mean"), *lat, mean_se("stage", "length")]
    )
    q["metric_panel"] = f"""WITH {NAMED}, {TRAITS}, {LENGTHS}, {lengths_by('taxon_name')}
SELECT year, CASE WHEN trait = 'trophic_level' THEN 'Trophic Level' WHEN trait = 'temp_mean' THEN 'Temperature'
  WHEN trait LIKE '%lat' THEN 'Latitude' ELSE 'Length' END AS "group", trait AS metric,
  {r('mean')} AS mean, {r('se')} AS se FROM ({every})"""
    bars = " UNION ALL ".join(
        f"SELECT year, '{m}' AS metric, avg({e}) AS mean, stddev_samp({e}) / sqrt(count(*)) AS se FROM ord GROUP BY year"
        for m, e in (("price", "price"), ("logprice", "ln(price)"))
    )
    q["metric_bars"] = (
        f"WITH {ORDERS} SELECT year, metric, {r('mean', 4)} AS mean, {r('se', 4)} AS se, {r('mean - se', 4)} AS lower, "
        f"{r('mean + se', 4)} AS upper FROM ({bars})"
    )
    q["repeated_lengths"] = (
        f"WITH {LENGTHS} SELECT year, grp, CAST(sum(freq) AS BIGINT) AS n, "
        f"{r('sum(length * freq) / sum(freq)')} AS length FROM lengths GROUP BY ALL"
    )
    q["tow_parts"] = """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
  count(*) AS n, CAST(0 AS BIGINT) AS timed, CAST(max(day(l_shipdate)) AS INTEGER) AS last_day,
  CAST(max(l_suppkey) AS INTEGER) AS last_station, sum(l_quantity) AS cpue FROM lineitem GROUP BY ALL"""

    q["monthly_environment"] = (
        f"WITH {ORDERS}, m AS (SELECT date, avg(price) AS price FROM ord GROUP BY date) "
        + calendar("m", [], f"{r('price', 3)} AS price")
    )
    q["daily_environment"] = (
        "WITH m AS (SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY ALL) "
        + calendar("m", ["event_type"], f"{r('value')} AS value", step="day")
    )
    q["seasonal_environment"] = (
        f"WITH {ORDERS} SELECT year, {SEASON} AS season, {r('avg(price)', 3)} AS price FROM ord GROUP BY year, season"
    )
    q["percent_saturation"] = f"""WITH w AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
    l_quantity / 2 AS t, l_quantity / 2 + 273.15 AS k, l_linenumber * 4.0 AS s, l_discount * 100 + 2 AS o,
    1.013253 AS p FROM lineitem),
v AS (SELECT *, exp(11.8571 - 3840.70 / k - 216961 / (k * k)) AS u,
    0.000975 - 1.426e-5 * t + 6.436e-8 * t * t AS th FROM w),
f AS (SELECT *, exp(-139.34411 + 1.575701e5 / k - 6.642308e7 / pow(k, 2) + 1.2438e10 / pow(k, 3)
    - 8.621949e11 / pow(k, 4)) * exp(-s * (0.017674 - 10.754 / k + 2140.7 / (k * k)))
    * ((p - u) * (1 - th * p)) / ((1 - u) * (1 - th)) AS sat FROM v)
SELECT year, month, {r('avg(t)')} AS bottom_temp, {r('avg(100 * o / sat)')} AS bottom_do_sat FROM f GROUP BY year, month"""
    q["mean_line"] = (
        f"WITH {OBS}, {diversity('obs', 'survey, date')} SELECT survey, date, {r('shannon')} AS shannon, "
        f"{r('avg(shannon) OVER (PARTITION BY survey)')} AS reference FROM div"
    )
    q["covariate_join"] = f"""WITH {OBS}, {ORDERS}, {rich.format('obs')},
idx AS (SELECT date, count(*) AS score FROM ord GROUP BY date),
peaks AS (SELECT date, max(price) AS peak FROM ord GROUP BY date),
cal AS ({calendar('peaks', [], 'peak')})
SELECT cal.date AS date, idx.score AS score, rich.richness AS richness, cal.peak AS peak
FROM cal LEFT JOIN rich ON rich.date = cal.date LEFT JOIN idx ON idx.date = rich.date"""

    line = """fit AS (
  SELECT survey, regr_slope(richness, year) AS slope, regr_intercept(richness, year) AS intercept,
    sqrt((regr_syy(richness, year) - regr_slope(richness, year) * regr_sxy(richness, year)) / (count(*) - 2)
      / regr_sxx(richness, year)) AS se, regr_r2(richness, year) AS r2, count(*) AS n,
    min(year) AS first, max(year) AS last, avg(year) AS mx, regr_sxx(richness, year) AS sxx FROM {} GROUP BY survey)"""
    q["richness_trend"] = f"""WITH {SURVEY}, {line.format('sr')}, t AS (SELECT *, slope / se AS t, n - 2 AS v FROM fit)
SELECT survey, {r('slope')} AS slope, {r('intercept', 3)} AS intercept, {r('se')} AS se, {r('t')} AS t,
  {r(student_p('t', 'v'))} AS p, {r('r2')} AS r2, n FROM t"""
    q["percent_change"] = f"""WITH {SURVEY}, {line.format('sr')},
c AS (SELECT survey, intercept + slope * first AS start_value, slope * (last - first) AS change FROM fit)
SELECT survey, {r('start_value', 5)} AS start_value, {r('change', 5)} AS change,
  {r('((start_value + change) / start_value - 1) * 100', 5)} AS percent FROM c"""
    # two-sided 95% point of t by bisection on the Simpson tail
    q["trend_band"] = f"""WITH RECURSIVE {OBS}, yr AS (SELECT survey, year, count(DISTINCT taxon) AS richness FROM obs GROUP BY ALL),
{line.format('yr')},
halves AS (
  SELECT survey, n - 2 AS v, CAST(0 AS DOUBLE) AS lo, CAST(64 AS DOUBLE) AS hi, 0 AS step FROM fit
  UNION ALL
  SELECT survey, v, CASE WHEN p > 0.05 THEN mid ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE mid END, step + 1
  FROM (SELECT survey, v, lo, hi, step, (lo + hi) / 2 AS mid, {student_p('((lo + hi) / 2)', 'v')} AS p
        FROM halves WHERE step < 40)),
q AS (SELECT survey, (lo + hi) / 2 AS q FROM halves WHERE step = 40),
b AS (SELECT survey, year, richness, intercept + slope * year AS fit,
  q * se * sqrt(sxx) * sqrt(1.0 / n + (year - mx) * (year - mx) / sxx) AS w
  FROM yr JOIN fit USING (survey) JOIN q USING (survey))
SELECT survey, year, richness, {r('fit', 4)} AS fit, {r('fit - w', 4)} AS lower, {r('fit + w', 4)} AS upper FROM b"""

    # factor model by within-month deviations
    q["month_factor_ols"] = f"""WITH {SERIES},
g AS (SELECT month, count(*) AS n, avg(year) AS mx, avg(richness) AS my FROM series GROUP BY month),
d AS (SELECT sum((year - mx) * (year - mx)) AS sxx, sum((year - mx) * (richness - my)) AS sxy,
  sum((richness - my) * (richness - my)) AS syy, count(*) - count(DISTINCT month) - 1 AS v
  FROM series JOIN g USING (month)),
s AS (SELECT *, sxy / sxx AS b, (syy - sxy * sxy / sxx) / v AS s2 FROM d),
one AS (SELECT n AS n1, mx AS mx1, my AS my1 FROM g WHERE month = 1),
rows AS (
  SELECT 'year' AS term, b AS estimate, sqrt(s2 / sxx) AS std_error, v FROM s
  UNION ALL SELECT '(Intercept)', my1 - b * mx1, sqrt(s2 * (1.0 / n1 + mx1 * mx1 / sxx)), v FROM s, one
  UNION ALL SELECT concat('month', month), (my - b * mx) - (my1 - b * mx1),
    sqrt(s2 * (1.0 / n + 1.0 / n1 + (mx - mx1) * (mx - mx1) / sxx)), v FROM s, one, g WHERE month > 1),
t AS (SELECT *, estimate / std_error AS t FROM rows)
SELECT term, {r('estimate', 4)} AS estimate, {r('std_error', 4)} AS std_error, {r('t', 4)} AS t,
  {r(student_p('t', 'v'), 4)} AS p FROM t"""
    two = """m AS (
  SELECT survey, count(*) AS n, avg(year) AS mx, avg(month) AS mz, avg(richness) AS my,
    regr_sxx(richness, year) AS xx, regr_sxx(richness, month) AS zz, regr_sxy(year, month) AS xz,
    regr_sxy(richness, year) AS xy, regr_sxy(richness, month) AS zy, regr_syy(richness, year) AS yy,
    min(year) AS first, max(year) AS last FROM sr GROUP BY survey),
b AS (SELECT *, xx * zz - xz * xz AS det, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx,
  (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM m),
s AS (SELECT *, my - bx * mx - bz * mz AS b0, (yy - bx * xy - bz * zy) / (n - 3) AS s2 FROM b)"""
    q["two_term_ols"] = f"""WITH {SURVEY}, {two}, rows AS (
  SELECT survey, '(Intercept)' AS term, b0 AS estimate,
    sqrt(s2 * (1.0 / n + (mx * mx * zz - 2 * mx * mz * xz + mz * mz * xx) / det)) AS std_error, n - 3 AS v FROM s
  UNION ALL SELECT survey, 'year', bx, sqrt(s2 * zz / det), n - 3 FROM s
  UNION ALL SELECT survey, 'month', bz, sqrt(s2 * xx / det), n - 3 FROM s)
SELECT survey, term, {r('estimate', 4)} AS estimate, {r('std_error', 4)} AS std_error,
  {r('t', 4)} AS t, {r(student_p('t', 'v'), 4)} AS p
FROM (SELECT *, estimate / std_error AS t FROM rows)"""
    q["ols_summary"] = f"""WITH {SURVEY}, {two}, f AS (SELECT survey, n, yy, yy - bx * xy - bz * zy AS rss FROM b)
SELECT survey, n, {r('1 - rss / yy', 4)} AS r2, {r('sqrt(rss / (n - 3))', 4)} AS sigma, {r('rss', 4)} AS deviance,
  {r('yy', 4)} AS null_deviance, {r('n * (ln(2 * pi() * rss / n) + 1) + 8', 4)} AS aic FROM f"""
    q["label_order"] = f"""WITH {OBS}, t AS (SELECT taxon, sum(cpue) AS n FROM obs GROUP BY taxon)
SELECT taxon, n, row_number() OVER (ORDER BY n, taxon) AS rank FROM t"""
    q["two_term_change"] = f"""WITH {SURVEY}, {two},
c AS (SELECT survey, b0 + bx * 1990 AS start_value, bx * (last - first) AS change FROM s)
SELECT survey, {r('start_value', 4)} AS start_value, {r('change', 4)} AS change,
  {r('((start_value + change) / start_value - 1) * 100', 4)} AS percent FROM c"""
    q["vif"] = f"""WITH {SERIES}, c AS (
  SELECT corr(year, month) AS a, corr(year, price) AS b, corr(month, price) AS c FROM series),
d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c)
SELECT 'year' AS term, {r('(1 - c * c) / det')} AS vif FROM d
UNION ALL SELECT 'month', {r('(1 - b * b) / det')} FROM d UNION ALL SELECT 'price', {r('(1 - a * a) / det')} FROM d"""

    q["mann_kendall"] = f"WITH {SURVEY}, " + kendall("sr", "survey", "survey", "date", "richness", True)
    q["seasonal_mann_kendall"] = f"WITH {SURVEY}, " + kendall("sr", "survey, month", "survey", "date", "richness", False)
    q["exact_mann_kendall"] = f"""WITH RECURSIVE {SURVEY}, {kendall_orders('sr', 'survey', 'month', 'richness', 'date')}
SELECT survey, n, CAST(seen.s AS BIGINT) AS s, {r('least(sum(p), 1)')} AS exact_p
FROM seen JOIN sizes USING (survey) JOIN c12 USING (survey) WHERE abs(c12.s) >= abs(seen.s) GROUP BY survey, n, seen.s"""
    q["station_mann_kendall"] = (
        "WITH daily AS (SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS cpue "
        "FROM lineitem GROUP BY ALL), " + kendall("daily", "station", "station", "day", "cpue", True)
    )
    q["cross_correlation"] = f"WITH {OBS}, {diversity('obs', 'survey, date')}, " + lagged(
        "div", "survey", "shannon", "total", 48, MONTHS
    )
    q["survey_cross_correlation"] = f"""WITH {SURVEY},
a AS (SELECT date, richness AS x FROM sr WHERE survey = 'A'),
b AS (SELECT date, richness AS y FROM sr WHERE survey = 'R'),
both_ AS (SELECT date, x, y FROM a JOIN b USING (date)), """ + lagged(
        "both_", "", "x", "y", 50, "row_number() OVER (ORDER BY date)"
    )

    q["poisson_glm"] = (
        f"WITH {SERIES}, {poisson_steps('series', 'price', 'month')} "
        + poisson_terms("fit", "model", "price", "month")
    )
    q["poisson_factor_glm"] = f"""WITH {SERIES},
g AS (SELECT month, avg(richness) AS m, sum(richness) AS s FROM series GROUP BY month),
one AS (SELECT m AS m1, s AS s1 FROM g WHERE month = 1),
rows AS (SELECT CASE WHEN month = 1 THEN '(Intercept)' ELSE concat('month', month) END AS term,
  CASE WHEN month = 1 THEN ln(m1) ELSE ln(m) - ln(m1) END AS b, CASE WHEN month = 1 THEN sqrt(1.0 / s1) ELSE sqrt(1.0 / s + 1.0 / s1) END AS e
  FROM g, one)
SELECT 'model' AS model_id, term, {r('b', 5)} AS estimate, {r('e', 5)} AS std_error, {r('b / e', 3)} AS z, {r(normal_p('(b / e)'))} AS p FROM rows"""
    mu = "mu AS (SELECT date, CAST(richness AS DOUBLE) AS richness, exp(b0 + b1 * price + b2 * month) AS fit FROM series, fit)"
    q["poisson_fit_summary"] = f"""WITH {SERIES}, {poisson_steps('series', 'price', 'month')}, {mu},
d AS (SELECT count(*) AS n, sum({DEVIANCE}) AS dev, sum(richness * ln(fit) - fit - lgamma(richness + 1)) AS ll FROM mu),
z AS (SELECT sum({DEVIANCE}) AS nul FROM (SELECT richness, avg(richness) OVER () AS fit FROM mu))
SELECT CAST(n AS DOUBLE) AS n, {r('dev', 4)} AS deviance, {r('nul', 4)} AS null_deviance,
  {r('1 - dev / nul', 4)} AS deviance_explained, {r('-2 * ll + 6', 4)} AS aic FROM d, z"""
    candidates = ("price", "year", "shannon")
    q["glm_one_by_one"] = (
        f"WITH {SERIES}, "
        + ", ".join(poisson_steps("series", c, "month", f"f_{c}") for c in candidates)
        + " "
        + " UNION ALL ".join(poisson_terms(f"f_{c}", c, c, "month", 4) for c in candidates)
    )
    waves = (
        "waves AS (SELECT date, richness, price, cos(2 * pi() * month / 10) AS cosine, "
        "sin(2 * pi() * month / 10) AS sine FROM series)"
    )
    q["harmonic_glm"] = (
        f"WITH {SERIES}, {waves}, {poisson_steps('waves', 'cosine', 'sine')} "
        + poisson_terms("fit", "model", "cosine", "sine")
    )
    every = {"price": ["price"], "year": ["year"], "shannon": ["shannon"], "harmonic(month)": ["cosine", "sine"]}
    q["model_selection"] = f"""WITH RECURSIVE {SERIES}, {all_subsets(every)}
SELECT CAST(rank AS INTEGER) AS rank, name AS model_id, {r('CAST(edf AS DOUBLE)')} AS edf, {r('deviance')} AS deviance, {r('aic')} AS aic,
  {r('delta')} AS delta, {r('weight')} AS weight, {r('cumulative')} AS cumulative, in_set FROM ranked"""
    q["best_subsets"] = f"{q['model_selection']} WHERE in_set"
    del every["shannon"]
    q["averaged_model"] = f"""WITH RECURSIVE {SERIES}, {all_subsets(every)},
used AS (SELECT name, weight / sum(weight) OVER () AS w FROM ranked WHERE in_set),
mean AS (SELECT term, sum(w * b) AS b, sum(w) AS share FROM est JOIN used USING (name) GROUP BY term),
var AS (SELECT e.term, any_value(m.b) AS b, any_value(share) AS share,
    sqrt(sum(w * (v + (e.b - m.b) * (e.b - m.b))) + (1 - any_value(share)) * any_value(m.b) * any_value(m.b)) AS e
  FROM est e JOIN used USING (name) JOIN mean m ON m.term = e.term GROUP BY e.term)
SELECT term, {r('b')} AS full_average, {r('e')} AS std_error, {r('b / e', 3)} AS z, {r(normal_p('(b / e)'))} AS p,
  {r('b / share')} AS conditional_average, {r('share')} AS importance FROM var"""
    signed = f"sign(richness - fit) * sqrt(greatest({DEVIANCE}, 0))"
    q["deviance_residuals"] = (
        f"WITH {SERIES}, {poisson_steps('series', 'price', 'month')}, {mu} "
        f"SELECT date, CAST(richness AS BIGINT) AS richness, {r('fit', 4)} AS fit, {r(signed, 4)} AS residual FROM mu"
    )
    q["residual_cross_correlation"] = (
        f"WITH {SERIES}, {waves}, {poisson_steps('waves', 'cosine', 'sine')}, "
        "mu AS (SELECT date, price, CAST(richness AS DOUBLE) AS richness, "
        "exp(b0 + b1 * cosine + b2 * sine) AS fit FROM waves, fit), "
        f"res AS (SELECT date, price, {signed} AS residual FROM mu), "
        + lagged("res", "", "price", "residual", 48, MONTHS)
    )

    smooth = f"WITH {SERIES}, {month_smooth(SMOOTHING)}"
    q["month_smooth"] = f"{smooth} SELECT month, {r('fit', 4)} AS fit, {r('sqrt(scale * v)', 4)} AS se FROM months, scaled"
    q["month_smooth_summary"] = f"""{smooth}
SELECT CAST(n AS DOUBLE) AS n, {r('edf', 4)} AS edf, {r('n * rss / pow(n - edf, 2)', 4)} AS gcv, {r('scale', 4)} AS scale, {r('1 - rss / yy', 4)} AS r2 FROM scaled"""

    # two factors as dummy columns of one system
    years = [f"CAST(year = y0 + {i} AS INTEGER)" for i in range(1, YEARS)]
    months = [f"CAST(month = {m} AS INTEGER)" for m in range(2, 13)]
    design = ["1", "price - mp", *years, *months]
    size = len(design)
    names = ["'(Intercept)'", "'price'", *[f"'year' || (y0 + {i})" for i in range(1, YEARS)], *[f"'month{m}'" for m in range(2, 13)]]
    gram = ", ".join(f"sum(CAST(x{i} AS DOUBLE) * x{j}) AS a{i}_{j}" for i in range(size) for j in range(i, size))
    sides = [f"sum(CAST(x{i} AS DOUBLE) * y) AS g{i}_0" for i in range(size)]
    sides += [f"{float(i == j)!r} AS g{i}_{j + 1}" for i in range(size) for j in range(size)]
    solved = eliminated(f"(SELECT count(*) AS n, sum(y * y) AS yy, any_value(mp) AS mp, any_value(y0) AS y0, {', '.join(f'sum(CAST(x{i} AS DOUBLE) * y) AS h{i}' for i in range(size))}, {gram}, {', '.join(sides)} FROM d)",
                        "n, yy, mp, y0, " + ", ".join(f"h{i}" for i in range(size)), size, size + 1)
    explained = " + ".join(f"s{i}_0 * h{i}" for i in range(size))
    head = "s0_0 - mp * s1_0", "s0_1 + mp * mp * s1_2 - 2 * mp * s0_2"
    each = [head, *[(f"s{i}_0", f"s{i}_{i + 1}") for i in range(1, size)]]
    parts = " UNION ALL ".join(f"SELECT {t} AS term, {b} AS b, s2 * ({v}) AS v FROM scaled" for t, (b, v) in zip(names, each, strict=True))
    q["two_factor_ols"] = f"""WITH {SERIES}, m AS (SELECT avg(price) AS mp, min(year) AS y0 FROM series),
d AS (SELECT mp, y0, CAST(richness AS DOUBLE) AS y, {', '.join(f'{c} AS x{i}' for i, c in enumerate(design))} FROM series, m),
solved AS (SELECT * FROM {solved}),
scaled AS (SELECT *, (yy - ({explained})) / (n - {size}) AS s2 FROM solved),
terms AS ({parts})
SELECT term, {r('b', 4)} AS estimate, {r('sqrt(v)', 4)} AS std_error FROM terms"""

    gam = f"WITH RECURSIVE {SERIES}, {penalised(SMOOTHING, ('price', 'year'))}"
    q["fixed_gam_terms"] = f"""{gam}
SELECT term, {r('b', 5)} AS estimate, {r('e', 5)} AS std_error, {r('b / e', 3)} AS z, {r(normal_p('(b / e)'), 5)} AS p, {r('edf', 5)} AS edf FROM terms
UNION ALL SELECT 's(month)', NULL, NULL, NULL, NULL, {r('edf - 3', 5)} FROM inv"""
    summary = f"""v AS (SELECT count(*) AS n, sum({DEVIANCE}) AS dev, sum(richness * ln(fit) - fit - lgamma(richness + 1)) AS ll FROM mu),
z AS (SELECT sum({DEVIANCE}) AS nul FROM (SELECT richness, avg(richness) OVER () AS fit FROM mu))
SELECT CAST(n AS DOUBLE) AS n, {r('edf', 5)} AS edf, {r('dev', 5)} AS deviance, {r('nul', 5)} AS null_deviance,
  {r('1 - dev / nul', 5)} AS deviance_explained, {r('ll', 5)} AS loglik, {r('2 * edf - 2 * ll', 5)} AS aic,
  {r('(dev + 2 * edf) / n - 1', 5)} AS ubre, true AS converged, false AS at_bound FROM v, z, inv"""
    q["fixed_gam_summary"] = f"{gam},\n{summary}"
    # with a centre at each month the thin plate is the natural cubic spline
    q["default_smooth_summary"] = f"WITH RECURSIVE {SERIES}, {penalised(SMOOTHING, ('price',), splines=natural_splines(12))},\n{summary}"
    q["fixed_gam_residuals"] = (
        f"{gam} SELECT date, CAST(richness AS BIGINT) AS richness, {r('fit', 4)} AS fit, {r(signed, 4)} AS residual FROM mu"
    )

    q["kernel_density"] = f"WITH {LENGTHS}, {lengths_by('taxon')}, " + kernel("stage", "length", 128, 8, 5)
    q["log_density"] = (
        f"WITH {LENGTHS}, {lengths_by('taxon')}, logs AS (SELECT year, ln(length) AS log_length FROM stage), "
        + kernel("logs", "log_length", 128, 7, 7)
    )
    q["local_smooth"] = (
        f"WITH {SURVEY}, {loess('sr', 'survey', DAYS, 80, 4)} "
        f"SELECT key AS survey, {r('g', 4)} AS x, {r('v', 4)} AS value FROM fitted"
    )
    q["price_smooth"] = (
        f"WITH {SERIES}, {loess('series', '0', 'price', 40, 3)} "
        f"SELECT {r('g', 3)} AS x, {r('v', 3)} AS value FROM fitted"
    )
    q["price_smooth_band"] = f"""WITH {SERIES}, {loess_errors(20)}
SELECT {r('x', 3)} AS x, {r('fit', 3)} AS fit, {r('sqrt(rr / one * vv)', 3)} AS std_error, {r('one * one / two', 3)} AS residual_df,
  {r('sqrt(rr / one)', 3)} AS scale FROM fits, deltas, residual"""
    quart = ", ".join(f"{r(f'quantile_cont(length, {p})')} AS q{i}" for i, p in enumerate((0.25, 0.5, 0.75)))
    q["length_quartiles"] = f"WITH {LENGTHS} SELECT year, {quart} FROM lengths GROUP BY year"
    q["harmonic_terms_by_month"] = f"""WITH {OBS} SELECT month, {r('max(cos(2 * pi() * month / 10))')} AS cosine,
  {r('max(sin(2 * pi() * month / 10))')} AS sine, count(*) AS n FROM obs GROUP BY month"""
    return {k: f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({v})" if k in DATED else v for k, v in q.items()}


ORACLES = _oracles()
