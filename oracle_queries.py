"""DuckDB equivalents of the queries in ``__spark_entry__``, over the same tables.

Tail probabilities are integrated numerically (Simpson's rule) inside the SQL.
"""

from __future__ import annotations

from statweave.functions import closed, tails


def union(rows: list[str]) -> str:
    return "\nUNION ALL\n".join(rows)


def simpson(density: str, upper: str, n: int = 1000) -> str:
    """∫₀^upper of a density written in terms of {x}."""
    x = f"(({upper}) * i / {n}.0)"
    weight = f"CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(SELECT sum(({weight}) * ({density.format(x=x)})) * ({upper}) / {n}.0 / 3.0 FROM range(0, {n + 1}) r(i))"


NORMAL = "exp(-0.5 * {x} * {x}) / sqrt(2 * pi())"


def normal_two_sided(z: str) -> str:
    return f"greatest(0.0, 1 - 2 * {simpson(NORMAL, f'least(abs({z}), 12.0)')})"


def normal_cdf(z: str) -> str:
    return f"(0.5 + sign({z}) * {simpson(NORMAL, f'least(abs({z}), 12.0)', 200)})"


def student_two_sided(t: str, df: str) -> str:
    """Through the angle atan(t/√df), whose density is a smooth power of the cosine."""
    body = f"exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(pi()) * pow(cos({{x}}), ({df}) - 1)"
    return f"greatest(0.0, 1 - 2 * {simpson(body, f'atan(abs({t}) / sqrt({df}))', 2000)})"


def chi2_upper(x: str, df: str) -> str:
    """Through the square root, whose density is smooth at zero."""
    body = f"2 * pow({{x}}, ({df}) - 1) * exp(-0.5 * {{x}} * {{x}} - ({df}) / 2.0 * ln(2) - lgamma(({df}) / 2.0))"
    return f"greatest(0.0, 1 - {simpson(body, f'sqrt({x})', 2000)})"


def polynomial(x: str, coefficients) -> str:
    """Lowest power first."""
    out = "0.0::DOUBLE"
    for c in reversed(coefficients):
        out = f"({c!r}::DOUBLE + ({x}) * {out})"
    return out


def shapiro(source: str, keys: str) -> str:
    """CTEs up to ``sw`` (keys, n, mean, sd, w, p): Shapiro-Wilk of x in ``source`` (keys, x), for more than 11 values.

    Normal scores by the rational approximations of the public algorithm AS 241.
    """
    near, mid, far = (f"{polynomial('{x}', a)} / {polynomial('{x}', b)}" for a, b in (tails._Q_NEAR, tails._Q_MID, tails._Q_FAR))
    score = f"""CASE WHEN abs(c) <= 0.425 THEN c * {near.format(x='0.180625 - c * c')} WHEN t <= 5 THEN sign(c) * {mid.format(x='t - 1.6')}
      ELSE sign(c) * {far.format(x='t - 5')} END"""
    return f"""sw_x AS ({source}),
sw_r AS (SELECT {keys}, x, x - avg(x) OVER (PARTITION BY {keys}) AS d, row_number() OVER (PARTITION BY {keys} ORDER BY x) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM sw_x),
sw_c AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) - 0.5 AS c FROM sw_r),
sw_t AS (SELECT *, sqrt(-ln(0.5 - abs(c))) AS t FROM sw_c), sw_m AS (SELECT *, {score} AS m FROM sw_t),
sw_s AS (SELECT {keys}, n, avg(x) AS mean, sum(m * d) AS smx, sum(m * m) AS smm, sum(d * d) AS ss, max(d) FILTER (i = 1) AS x1, max(d) FILTER (i = 2) AS x2,
  max(d) FILTER (i = n - 1) AS xm, max(d) FILTER (i = n) AS xn, max(m) FILTER (i = n) AS l, max(m) FILTER (i = n - 1) AS b FROM sw_m GROUP BY {keys}, n),
sw_a AS (SELECT *, {polynomial('1 / sqrt(n)', closed._C1)} + l / sqrt(smm) AS an, {polynomial('1 / sqrt(n)', closed._C2)} + b / sqrt(smm) AS am FROM sw_s),
sw_p AS (SELECT *, (smm - 2 * l * l - 2 * b * b) / (1 - 2 * an * an - 2 * am * am) AS phi FROM sw_a),
sw_w AS (SELECT *, CASE WHEN ss > 0 THEN least(1.0, pow((smx - l * (xn - x1) - b * (xm - x2)) / sqrt(phi) + an * (xn - x1) + am * (xm - x2), 2) / ss) ELSE 1 END AS w FROM sw_p),
sw_z AS (SELECT *, CASE WHEN w < 1 THEN (ln(1 - w) - {polynomial('ln(n)', closed._C5)}) / exp({polynomial('ln(n)', closed._C6)}) END AS z FROM sw_w),
sw AS (SELECT {keys}, n, mean, sqrt(ss / (n - 1)) AS sd, w, CASE WHEN w < 1 THEN greatest(0.0, 1 - {normal_cdf('z')}) ELSE 1 END AS p FROM sw_z)"""


def kolmogorov(lam: str) -> str:
    terms = f"sum(2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * ({lam}) * ({lam})))"
    return f"CASE WHEN ({lam}) < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, (SELECT {terms} FROM range(1, 101) r(k)))) END"


def fits(source: str, one_round: int = 25) -> str:
    """CTEs from ``source`` (k, x) to all four fitted laws, ``fitted`` (k, law, place, statistic, p, s, loc, scale, rate)."""
    rounds = []
    for r in range(1, 4):
        rounds.append(f"""t{r} AS MATERIALIZED (SELECT k, m, lo, a, b, CASE WHEN i < 24 THEN exp(a + i * ((b - a) / 23)) ELSE lo END AS gap FROM g{r - 1}, range(0, {one_round}) q(i)),
l{r} AS MATERIALIZED (SELECT k, gap, any_value(m) AS m, any_value(lo) AS lo, any_value((b - a) / 23) AS step, sum(w * l) / sum(w) AS a1, sum(w * l * l) / sum(w) AS a2
  FROM (SELECT t{r}.*, w, ln((x - lo + gap) / (m - lo + gap)) AS l FROM v JOIN t{r} USING (k)) GROUP BY k, gap),
h{r} AS (SELECT *, sqrt(greatest(0.0, a2 - a1 * a1)) AS s, a1 + ln(m - lo + gap) AS lm FROM l{r}),
g{r} AS MATERIALIZED (SELECT k, m, lo, ln(gap) - step AS a, ln(gap) + step AS b, gap, s, lm FROM h{r} WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY ln(s) + lm, gap) = 1)""")
    shape = [normal_cdf("(x - m) / sd"), "1 - exp(-(x - lo) / (m - lo))", normal_cdf("ln((x - (lo - gap)) / exp(lm)) / s")]
    return f"""WITH RECURSIVE src AS ({source}),
st AS MATERIALIZED (SELECT k, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd, min(x) AS lo, max(x) AS hi, bool_and(x = round(x)) AS whole FROM src GROUP BY k HAVING count(*) >= 5),
v AS MATERIALIZED (SELECT k, x, count(*) AS w FROM src SEMI JOIN st USING (k) GROUP BY k, x),
g0 AS (SELECT k, m, lo, ln((hi - lo) * 1e-6) AS a, ln((hi - lo) * 1e3) AS b FROM st WHERE lo > 0 AND hi > lo),
{", ".join(rounds)},
run AS (SELECT v.*, st.n, st.m, st.sd, st.lo, g3.gap, g3.s, g3.lm, sum(w) OVER (PARTITION BY v.k ORDER BY x) AS cum FROM v JOIN st USING (k) LEFT JOIN g3 USING (k)),
laws AS (SELECT k, n, cum::DOUBLE / n AS up, (cum - w)::DOUBLE / n AS low, {shape[0]} AS f1, CASE WHEN s IS NOT NULL THEN {shape[2]} END AS f2, CASE WHEN m > lo THEN {shape[1]} END AS f3 FROM run),
d AS (SELECT k, max(n) AS n, [max(greatest(up - f1, f1 - low)), max(greatest(up - f2, f2 - low)), max(greatest(up - f3, f3 - low))] AS ds FROM laws GROUP BY k),
far AS (SELECT k, lo, m AS lam, n FROM st WHERE whole AND lo >= 0),
w0 AS (SELECT v.*, lam, n, row_number() OVER (PARTITION BY k ORDER BY x) AS i, lead(x) OVER (PARTITION BY k ORDER BY x) AS nx FROM v JOIN far USING (k)),
cells AS MATERIALIZED (SELECT k, w, i, CASE WHEN nx IS NULL THEN n ELSE n * list_sum(list_transform(range(0, nx::BIGINT), lambda j: exp(j * ln(lam) - lam - lgamma(j + 1)))) END
  - CASE WHEN i = 1 THEN 0 ELSE n * list_sum(list_transform(range(0, x::BIGINT), lambda j: exp(j * ln(lam) - lam - lgamma(j + 1)))) END AS e FROM w0),
walk AS (SELECT k, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS o, CAST(0 AS DOUBLE) AS e FROM far UNION ALL
  SELECT cells.k, cells.i, CASE WHEN walk.e >= 5 THEN 0 ELSE walk.o END + cells.w, CASE WHEN walk.e >= 5 THEN 0 ELSE walk.e END + cells.e
  FROM walk JOIN cells ON cells.k = walk.k AND cells.i = walk.i + 1),
bins AS (SELECT *, i = max(i) OVER (PARTITION BY k) AS last FROM walk WHERE e >= 5),
rest AS (SELECT k, arg_max(if(e < 5, o, 0), i) AS o, arg_max(if(e < 5, e, 0), i) AS e FROM walk GROUP BY k),
pois AS (SELECT bins.k, sum(pow(bins.o + if(last, rest.o, 0) - bins.e - if(last, rest.e, 0), 2) / (bins.e + if(last, rest.e, 0))) AS chi2, count(*) - 2 AS df FROM bins JOIN rest USING (k) GROUP BY bins.k HAVING count(*) > 2),
each AS (SELECT k, j, ds[j] AS d, ds[j] * sqrt(n) AS lam FROM d, range(1, 4) q(j) WHERE ds[j] IS NOT NULL),
fitted AS (
  SELECT each.k, ['norm', 'lognorm', 'expon'][j] AS law, j AS place, d AS statistic, {kolmogorov('lam')} AS p, if(j = 2, s, NULL) AS s,
    CASE j WHEN 1 THEN st.m WHEN 2 THEN st.lo - gap ELSE st.lo END AS loc, CASE j WHEN 1 THEN sd WHEN 2 THEN exp(lm) ELSE st.m - st.lo END AS scale, CAST(NULL AS DOUBLE) AS rate
  FROM each JOIN st USING (k) LEFT JOIN g3 USING (k)
  UNION ALL SELECT k, 'poisson', 4, chi2, {chi2_upper('chi2', 'df')}, NULL, NULL, NULL, lam FROM pois JOIN far USING (k)),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, place) = 1 AS top FROM fitted)"""


def fit_rows(extra: str, more: str = "") -> str:
    return (f'SELECT {extra}, law AS distribution, round(statistic, 6) AS statistic, round(p, 6) AS p_value{more}, '
            "round(s, 6) AS p_s, round(loc, 6) AS p_loc, round(scale, 6) AS p_scale, round(rate, 6) AS p_lambda, 'ok' AS status FROM best")


def k2(n: str, g1: str, g2: str) -> str:
    """D'Agostino–Pearson statistic as nested lateral columns; use inside a FROM list."""
    return f"""
    SELECT src.*, z1 * z1 + z2 * z2 AS k2 FROM (
      SELECT src.*,
        asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
        (1 - 2 / (9 * a) - sign(dd) * pow((1 - 2 / a) / abs(dd), 1.0 / 3)) / sqrt(2 / (9 * a)) AS z2
      FROM (SELECT src.*, 1 + xx * sqrt(2 / (a - 4)) AS dd FROM (
        SELECT src.*, 6 + 8 / q * (2 / q + sqrt(1 + 4 / (q * q))) AS a FROM (
          SELECT src.*,
            {g1} * sqrt((nn + 1) * (nn + 3) / (6 * (nn - 2))) AS y,
            sqrt(2 * (3 * (nn * nn + 27 * nn - 70) * (nn + 1) * (nn + 3) / ((nn - 2) * (nn + 5) * (nn + 7) * (nn + 9)) - 1)) - 1 AS w2,
            ({g2} + 3 - 3 * (nn - 1) / (nn + 1)) / sqrt(24 * nn * (nn - 2) * (nn - 3) / ((nn + 1) * (nn + 1) * (nn + 3) * (nn + 5))) AS xx,
            6 * (nn * nn - 5 * nn + 2) / ((nn + 7) * (nn + 9)) * sqrt(6 * (nn + 3) * (nn + 5) / (nn * (nn - 2) * (nn - 3))) AS q
          FROM (SELECT src.*, ({n})::DOUBLE AS nn FROM src) src
        ) src) src) src) src"""


GAPS = """gaps AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag,
  CASE WHEN l_linenumber IN (3, 5) THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE l_tax END AS l_tax FROM lineitem)"""

SIDES = """a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
b AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN year(o_orderdate) = 2000 THEN NULL ELSE o_totalprice * 1.05 END AS o_totalprice, o_orderdate,
  CASE WHEN year(o_orderdate) = 2001 THEN '0-NOW' ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"""

SIDES_LONG = "long AS (" + union(
    [f"SELECT '{c}' AS \"column\", {s} AS side, {c}::DOUBLE AS x FROM {t} WHERE {c} IS NOT NULL"
     for c in ("o_custkey", "o_orderkey", "o_totalprice") for s, t in ((0, "a"), (1, "b"))]
) + ")"

FLAGS_LONG = "long AS (" + union(
    [f"SELECT '{c}' AS \"column\", CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS side, {c} AS x FROM lineitem WHERE l_returnflag IN ('A', 'R')"
     for c in ("l_quantity", "l_extendedprice", "l_discount")]
) + ")"

# Everything the two-sample tests need, from a CTE long(column, side, x).
TWO_SAMPLE = """
mom AS (SELECT "column",
  count(*) FILTER (side = 0) AS n_a, count(*) FILTER (side = 1) AS n_b,
  avg(x) FILTER (side = 0) AS mean_a, avg(x) FILTER (side = 1) AS mean_b,
  stddev_samp(x) FILTER (side = 0) AS std_a, stddev_samp(x) FILTER (side = 1) AS std_b,
  var_samp(x) FILTER (side = 0) AS var_a, var_samp(x) FILTER (side = 1) AS var_b,
  skewness(x) FILTER (side = 0) AS sk_a, skewness(x) FILTER (side = 1) AS sk_b,
  kurtosis(x) FILTER (side = 0) AS ku_a, kurtosis(x) FILTER (side = 1) AS ku_b,
  median(x) FILTER (side = 0) AS med_a, median(x) FILTER (side = 1) AS med_b FROM long GROUP BY "column"),
vals AS (SELECT "column", x, count(*) FILTER (side = 0) AS ca, count(*) FILTER (side = 1) AS cb FROM long GROUP BY ALL),
run AS (SELECT *, sum(ca) OVER w AS cum_a, sum(cb) OVER w AS cum_b FROM vals WINDOW w AS (PARTITION BY "column" ORDER BY x)),
rk AS (SELECT "column",
  sum(ca * (cum_a + cum_b - (ca + cb - 1) / 2.0)) AS rank_a,
  sum(pow((ca + cb)::DOUBLE, 3) - (ca + cb)) AS ties,
  max(abs(cum_a::DOUBLE / n_a - cum_b::DOUBLE / n_b)) AS d FROM run JOIN mom USING ("column") GROUP BY "column"),
lev0 AS (SELECT "column", side, count(*)::DOUBLE AS n, avg(abs(x - CASE side WHEN 0 THEN med_a ELSE med_b END)) AS z,
  var_pop(abs(x - CASE side WHEN 0 THEN med_a ELSE med_b END)) AS v FROM long JOIN mom USING ("column") GROUP BY "column", side),
lev1 AS (SELECT "column", sum(n) AS n, sum(n * z) / sum(n) AS zz, sum(n * v) AS within FROM lev0 GROUP BY "column"),
lev AS (SELECT "column", any_value(lev1.n) - 2 AS d2,
  (any_value(lev1.n) - 2) * sum(lev0.n * pow(z - zz, 2)) / any_value(within) AS f FROM lev0 JOIN lev1 USING ("column") GROUP BY "column"),
base AS (SELECT *, n_a::DOUBLE AS n1, n_b::DOUBLE AS n2 FROM mom JOIN rk USING ("column") JOIN lev USING ("column")),
stats AS (SELECT *,
  rank_a - n1 * (n1 + 1) / 2 AS u,
  sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS us,
  sqrt(((n1 - 1) * var_a + (n2 - 1) * var_b) / (n1 + n2 - 2)) AS sp,
  (mean_a - mean_b) / sqrt(var_a / n1 + var_b / n2) AS welch_t,
  pow(var_a / n1 + var_b / n2, 2) / (pow(var_a / n1, 2) / (n1 - 1) + pow(var_b / n2, 2) / (n2 - 1)) AS welch_df,
  -- population shape back from the bias-corrected one
  sk_a * (n1 - 2) / sqrt(n1 * (n1 - 1)) AS g1_a, sk_b * (n2 - 2) / sqrt(n2 * (n2 - 1)) AS g1_b,
  (ku_a * (n1 - 2) * (n1 - 3) / (n1 - 1) - 6) / (n1 + 1) AS g2_a, (ku_b * (n2 - 2) * (n2 - 3) / (n2 - 1) - 6) / (n2 + 1) AS g2_b
  FROM base)"""

# The continuity correction ends at zero.
U_P = normal_two_sided("greatest(0.0, abs(u - n1 * n2 / 2) - 0.5) / us")
COHEN = "(mean_a - mean_b) / sp"
STUDENT_T = "(mean_a - mean_b) / (sp * sqrt(1 / n1 + 1 / n2))"
BISERIAL = "1 - 2 * u / (n1 * n2)"


def label(x: str, steps: list[tuple[str, str]], last: str) -> str:
    return "CASE " + " ".join(f"WHEN abs({x}) < {v} THEN '{name}'" for v, name in steps) + f" ELSE '{last}' END"


def cohen_label(x: str) -> str:
    return label(x, [("0.2", "negligible"), ("0.5", "small"), ("0.8", "medium"), ("1.2", "large")], "very_large")


def biserial_label(x: str) -> str:
    return label(x, [("0.1", "negligible"), ("0.3", "small"), ("0.5", "medium")], "large")


# The chosen test per column: normality by K² (samples over 300), Levene, then the test.
DECIDED = f"""
ka AS (WITH src AS (SELECT "column", n_a, g1_a, g2_a FROM stats) {k2('n_a', 'g1_a', 'g2_a')}),
kb AS (WITH src AS (SELECT "column", n_b, g1_b, g2_b FROM stats) {k2('n_b', 'g1_b', 'g2_b')}),
judged AS (SELECT stats.*, ka.k2 AS k2_a, kb.k2 AS k2_b, exp(-ka.k2 / 2) >= 0.05 AS ok_a, exp(-kb.k2 / 2) >= 0.05 AS ok_b,
  {student_two_sided('sqrt(f)', 'd2')} AS levene_p
  FROM stats JOIN ka USING ("column") JOIN kb USING ("column")),
named AS (SELECT *, CASE WHEN ok_a AND ok_b THEN (CASE WHEN levene_p >= 0.05 THEN 'student' ELSE 'welch' END) ELSE 'mann_whitney' END AS test FROM judged),
chosen AS (SELECT *,
  CASE test WHEN 'student' THEN {STUDENT_T} WHEN 'welch' THEN welch_t ELSE u END AS statistic,
  CASE test WHEN 'student' THEN {student_two_sided(STUDENT_T, 'n1 + n2 - 2')} WHEN 'welch' THEN {student_two_sided('welch_t', 'welch_df')} ELSE {U_P} END AS p_value,
  CASE test WHEN 'mann_whitney' THEN {BISERIAL} ELSE {COHEN} END AS effect_size FROM named)"""

PSI = """
edges AS (SELECT "column", list_sort(list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e,
  count(*) AS n FROM long WHERE side = 0 GROUP BY "column"),
binned AS (SELECT "column", side, CASE WHEN x < e[1] OR x > e[-1] THEN NULL
  ELSE least(len(list_filter(e, lambda v: v <= x)), len(e) - 1) END AS bin FROM long JOIN edges USING ("column")),
sizes AS (SELECT "column", count(*) FILTER (side = 0) AS n_a, count(*) FILTER (side = 1) AS n_b FROM long GROUP BY "column"),
frame AS (SELECT "column", unnest(range(1, len(e))) AS bin FROM edges),
cells AS (SELECT frame."column", frame.bin, count(*) FILTER (side = 0) AS ca, count(*) FILTER (side = 1) AS cb
  FROM frame LEFT JOIN binned ON frame."column" = binned."column" AND frame.bin = binned.bin GROUP BY ALL),
psis AS (SELECT "column", sum((pb - pa) * ln(pb / pa)) AS psi FROM (
  SELECT "column", CASE WHEN ca = 0 THEN 0.0001 ELSE ca::DOUBLE / n_a END AS pa,
    CASE WHEN cb = 0 THEN 0.0001 ELSE cb::DOUBLE / n_b END AS pb FROM cells JOIN sizes USING ("column")) GROUP BY "column")"""

PSI_LABEL = "CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.2 THEN 'moderate' ELSE 'significant' END"

NUMERIC = f"""ranked AS (SELECT *, row_number() OVER (ORDER BY p_value) AS r, count(*) OVER () AS m FROM chosen JOIN psis USING ("column")),
adjusted AS (SELECT *, least(1.0, min(p_value * m / r) OVER (ORDER BY r DESC)) AS p_corrected,
  d * sqrt(n1 * n2 / (n1 + n2)) AS lam, mean_b - mean_a AS delta FROM ranked),
drifted AS (SELECT *, {kolmogorov('lam')} AS ks_p FROM adjusted),
verdicts AS (SELECT *, CASE WHEN p_corrected > 0.05 OR p_value >= 0.05 THEN 'no_difference'
  WHEN abs(effect_size) < 0.2 THEN 'significant_small_effect' WHEN delta > 0 THEN 'significant_increase'
  WHEN delta < 0 THEN 'significant_decrease' ELSE 'significant_difference' END AS verdict FROM drifted)"""


def describe(source: str, columns: list[str], by: str = "") -> str:
    """Extended statistics per column."""
    group = f"{by}, " if by else ""
    parts = union([f"SELECT {group}'{c}' AS \"column\", {c}::DOUBLE AS x FROM {source}" for c in columns])
    sk, ku = "coalesce(skewness(x), 0)", "coalesce(kurtosis(x), 0)"
    return f"""WITH long AS ({parts})
SELECT {group}"column", count(x) AS count, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median,
  round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max,
  round(quantile_cont(x, 0.25), 4) AS q25, round(quantile_cont(x, 0.75), 4) AS q75,
  round({sk}, 4) + 0.0 AS skewness, round({ku}, 4) + 0.0 AS kurtosis, round(stddev_samp(x) / sqrt(count(x)), 4) AS sem,
  min(x) = max(x) AS is_constant,
  concat_ws('; ', CASE WHEN {sk} > 0.5 THEN 'right' WHEN {sk} < -0.5 THEN 'left' ELSE 'symmetric' END,
    CASE WHEN {ku} > 0.5 THEN 'peaked' WHEN {ku} < -0.5 THEN 'flat' ELSE 'mesokurtic' END) AS shape
FROM long GROUP BY {group}"column" """


def fill(value: str, tax: str) -> str:
    return f"""WITH {GAPS} SELECT l_orderkey, l_partkey, l_linenumber, round(coalesce(l_quantity, (SELECT {value} FROM gaps)), 6) AS l_quantity,
  round(coalesce(l_tax, (SELECT {tax} FROM gaps)), 6) AS l_tax FROM gaps"""


def mode(c: str) -> str:
    return f"first(c ORDER BY k DESC, c) FROM (SELECT {c} AS c, count(*) AS k FROM gaps WHERE {c} IS NOT NULL GROUP BY {c})"


def fill_mode() -> str:
    parts = ", ".join(f"round(coalesce({c}, (SELECT {mode(c)})), 6) AS {c}" for c in ("l_quantity", "l_tax"))
    return f"WITH {GAPS} SELECT l_orderkey, l_partkey, l_linenumber, {parts} FROM gaps"


def outliers(by: str = "") -> str:
    group, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    grouped = f"GROUP BY {by}" if by else ""
    return f"""WITH q AS (SELECT {group}quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events {grouped})
SELECT {group}'value' AS "column", round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, round(any_value(q3 - q1), 4) AS iqr,
  round(any_value(q1 - 1.5 * (q3 - q1)), 4) AS lower_bound, round(any_value(q3 + 1.5 * (q3 - q1)), 4) AS upper_bound,
  count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers_count,
  round(count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 100.0::DOUBLE / count(*), 2) AS outliers_percent,
  count(*) AS total_rows FROM events JOIN q {on} {grouped}"""


FENCE = "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) q"
INSIDE = "value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"


def pearson(source: str, columns: list[str], head: str = "") -> str:
    cells = []
    for a in columns:
        for b in columns:
            r = "CASE WHEN min({0}) < max({0}) THEN 1.0 ELSE 0.0 END".format(a) if a == b else f"round(coalesce(corr({a}, {b}), 0), 4) + 0.0"
            cells.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r} AS r FROM {source}")
    return head + union(cells)


def spearman(source: str, columns: list[str], head: str = "") -> str:
    cells = []
    for a in columns:
        for b in columns:
            if a == b:
                cells.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, 1.0 AS r")
                continue
            ranked = ", ".join(
                f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r{n}" for n, c in enumerate((a, b))
            )
            cells.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr(r0, r1), 4) + 0.0 AS r FROM "
                         f"(SELECT {ranked} FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
    return head + union(cells)


def chi2(source: str, a: str, b: str, p: str, by: str = "") -> str:
    """χ² over the dense table, Yates for one degree of freedom; ``p`` uses chi2 (and dof)."""
    g, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    on = f"{by}" if by else "one"
    return f"""WITH t AS (SELECT 1 AS one, {g}{a}::VARCHAR AS va, {b}::VARCHAR AS vb, count(*) AS o FROM {source} GROUP BY ALL),
rows_ AS (SELECT {on}, va, sum(o) AS r FROM t GROUP BY ALL), cols_ AS (SELECT {on}, vb, sum(o) AS c FROM t GROUP BY ALL),
tot AS (SELECT {on}, sum(o) AS n, count(DISTINCT va) AS rr, count(DISTINCT vb) AS cc FROM t GROUP BY ALL),
dense AS (SELECT rows_.{on}, coalesce(o, 0) AS o, r::DOUBLE * c / n AS e, n, rr, cc FROM rows_ JOIN cols_ USING ({on}) JOIN tot USING ({on})
  LEFT JOIN t ON t.{on} = rows_.{on} AND t.va = rows_.va AND t.vb = cols_.vb),
s AS (SELECT {on}, any_value(n)::BIGINT AS n, (any_value(rr) - 1) * (any_value(cc) - 1) AS dof, least(any_value(rr), any_value(cc)) - 1 AS k,
  sum(pow(CASE WHEN (rr - 1) * (cc - 1) = 1 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE o - e END, 2) / e) AS chi2,
  count(*) FILTER (e < 5) AS low_expected_cells, count(*) AS total_cells FROM dense GROUP BY {on})
SELECT {g}{{}} FROM (SELECT *, {p} AS p_value, sqrt(chi2 / (n * k)) AS v FROM s) s"""


CHI2_OUT = """round(chi2, 6) AS chi2, round(p_value, 6) AS p_value, dof, n, round(v, 6) AS cramers_v,
  CASE WHEN v < 0.1 THEN 'none' WHEN v < 0.3 THEN 'weak' WHEN v < 0.5 THEN 'moderate' ELSE 'strong' END AS strength, low_expected_cells, total_cells"""
EVEN_8 = "exp(-chi2 / 2) * (1 + chi2 / 2 + pow(chi2 / 2, 2) / 2 + pow(chi2 / 2, 3) / 6)"


OLS = """m AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
  var_pop(l_quantity) AS v11, var_pop(l_discount) AS v22, covar_pop(l_quantity, l_discount) AS v12,
  covar_pop(l_quantity, l_extendedprice) AS v1y, covar_pop(l_discount, l_extendedprice) AS v2y, var_pop(l_extendedprice) AS vyy FROM lineitem),
b AS (SELECT *, v11 * v22 - v12 * v12 AS det, (v22 * v1y - v12 * v2y) / (v11 * v22 - v12 * v12) AS b1, (v11 * v2y - v12 * v1y) / (v11 * v22 - v12 * v12) AS b2 FROM m),
fit AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (vyy - b1 * v1y - b2 * v2y) AS sse FROM b),
f2 AS (SELECT *, sse / (n - 3) AS s2, v22 / det / n AS i11, v11 / det / n AS i22, -v12 / det / n AS i12 FROM fit),
f3 AS (SELECT *, 1 / (1 - pow(v12 + m1 * m2, 2) / ((v11 + m1 * m1) * (v22 + m2 * m2))) AS vif,
  sqrt(s2 * (1 / n + m1 * m1 * i11 + 2 * m1 * m2 * i12 + m2 * m2 * i22)) AS e0, sqrt(s2 * i11) AS e1, sqrt(s2 * i22) AS e2 FROM f2)"""


def ols_term(name: str, b: str, e: str, vif: str) -> str:
    t = f"{b} / {e}"
    p = student_two_sided(t, "n - 3")
    return (f"SELECT '{name}' AS term, {b} AS coefficient, {e} AS std_error, {t} AS t, {p} AS p_value, {vif} AS vif FROM f3")


LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_tax"

CALENDAR_D = "SELECT unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS d"

DAILY_EVENTS = "daily AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, sum(value) AS total FROM events GROUP BY ALL)"


def regularity(source: str, key: str, ts: str) -> str:
    """Points, range and gaps per key; every table here is uneven or daily."""
    return f"""steps AS (SELECT {key}, {ts} AS ts, epoch_us({ts}) - lag(epoch_us({ts})) OVER (PARTITION BY {key} ORDER BY {ts}) AS step FROM {source}),
med AS (SELECT {key}, median(step) AS m, count(*) AS total, min(ts) AS first_, max(ts) AS last_, min(step) AS s0, max(step) AS s1 FROM steps GROUP BY {key}),
found AS (SELECT {key}, any_value(total) AS total, any_value(first_) AS first_, any_value(last_) AS last_,
  CASE WHEN any_value(s0) = any_value(s1) AND any_value(s0) = 86400000000 THEN 'D' END AS freq,
  count(*) FILTER (step > 1.5 * m) AS gaps FROM steps JOIN med USING ({key}) GROUP BY {key})"""


REGULAR_OUT = """total >= 3 AS is_valid, total AS total_points, strftime(first_, '%Y-%m-%d') AS range_start, strftime(last_, '%Y-%m-%d') AS range_end,
  freq, CASE freq WHEN 'D' THEN 'daily' END AS freq_name, gaps AS gaps_count"""
ADVICE = "freq IS NOT NULL AND gaps = 0 AS is_regular, CASE WHEN freq IS NULL THEN 'resample_unknown_frequency' WHEN gaps > 0 THEN 'resample_to_fill_gaps' ELSE '' END AS suggestions"


def profile_sql(name: str, columns: list[tuple[str, str, str]]) -> str:
    return union([
        f"SELECT '{c}' AS \"column\", '{kind}' AS kind, '{dtype}' AS dtype, count(*) AS rows, count({c}) AS non_null FROM {name}"
        for c, kind, dtype in columns
    ])


ORDERS_COLUMNS = [
    ("o_orderkey", "numeric", "bigint"), ("o_custkey", "numeric", "bigint"), ("o_orderstatus", "categorical", "string"),
    ("o_totalprice", "numeric", "double"), ("o_orderdate", "datetime", "timestamp_ntz"), ("o_orderpriority", "categorical", "string"),
]
GAPS_COLUMNS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_linenumber", "int"), ("l_returnflag", "string"), ("l_quantity", "double"), ("l_tax", "double")]

TEXTS = ("o_orderstatus", "o_orderpriority")


def fresh(c: str) -> str:
    """Values of a text column that only side B has."""
    return f"(SELECT {c} AS v FROM b WHERE {c} IS NOT NULL EXCEPT SELECT {c} FROM a)"


ORACLES: dict[str, str] = {
    "profile_orders": profile_sql("orders", ORDERS_COLUMNS),
    "missing_lineitem": f"WITH {GAPS} " + union([
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_percent FROM gaps"
        for c, t in GAPS_COLUMNS]),
    "missing_by_flag": f"WITH {GAPS} " + union([
        f"SELECT l_returnflag, '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_percent FROM gaps GROUP BY l_returnflag"
        for c, t in GAPS_COLUMNS if c != "l_returnflag"]),
    "distinct_preview_orders": union([
        f"SELECT '{c}' AS \"column\", count(*) AS distinct_count, count(*) > 10 AS has_more, array_to_string(list_sort(list(v))[1:10], '|') AS \"values\" FROM (SELECT DISTINCT {c} AS v FROM orders)"
        for c in ("o_orderstatus", "o_orderpriority")]),
    "promote_dates_orders": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS placed, o_orderpriority FROM orders""",
    "drop_missing_lineitem": f"WITH {GAPS} SELECT l_orderkey, l_partkey, l_linenumber, round(l_quantity, 6) AS l_quantity, round(l_tax, 6) AS l_tax FROM gaps WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL",
    "drop_missing_report": f"WITH {GAPS} SELECT count(*) AS rows_before, count(l_quantity) AS rows_after, count(*) - count(l_quantity) AS affected_count FROM gaps",
    "fill_mean_lineitem": fill("avg(l_quantity)", "avg(l_tax)"),
    "fill_median_lineitem": fill("median(l_quantity)", "median(l_tax)"),
    "fill_mode_lineitem": fill_mode(),
    "fill_mean_by_flag": f"WITH {GAPS} SELECT l_orderkey, l_partkey, l_linenumber, round(coalesce(l_quantity, avg(l_quantity) OVER (PARTITION BY l_returnflag)), 6) AS l_quantity FROM gaps",
    "fill_report_lineitem": f"WITH {GAPS} SELECT count(*) AS rows_before, count(*) AS rows_after, 2 * count(*) - count(l_quantity) - count(l_tax) AS affected_count FROM gaps",
    "iqr_outliers_events": outliers(),
    "iqr_outliers_by_type": outliers("event_type"),
    "remove_outliers_events": f"SELECT event_id, round(value, 6) AS value FROM events, {FENCE} WHERE {INSIDE}",
    "remove_outliers_report": f"SELECT count(*) AS rows_before, count(*) FILTER ({INSIDE}) AS rows_after, count(*) FILTER (NOT ({INSIDE})) AS affected_count FROM events, {FENCE}",
    "encode_priority": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE (dense_rank() OVER (PARTITION BY o_orderstatus = 'P' ORDER BY o_orderpriority) - 1)::INTEGER END AS o_orderpriority FROM orders""",
    "priority_codes": union([
        f"SELECT '{c}' AS \"column\", (row_number() OVER (ORDER BY v) - 1)::INTEGER AS code, v AS value FROM (SELECT DISTINCT {c} AS v FROM orders)"
        for c in ("o_orderpriority", "o_orderstatus")]),
    "scale_standard_part": "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) + 0.0 AS p_retailprice FROM part",
    "scale_minmax_part": "SELECT p_partkey, round((p_size - min(p_size) OVER ())::DOUBLE / (max(p_size) OVER () - min(p_size) OVER ()), 6) AS p_size, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part",
    "scale_standard_by_brand": "SELECT p_partkey, round((p_size - avg(p_size) OVER w) / stddev_pop(p_size) OVER w, 6) + 0.0 AS p_size FROM part WINDOW w AS (PARTITION BY p_brand)",
    "clean_regression_rows": """WITH t AS (SELECT l_linenumber IN (4, 6) AS infinite, l_linenumber IN (3, 7) AS missing FROM lineitem)
SELECT count(*) AS original, count(*) FILTER (NOT (infinite OR missing)) AS cleaned, count(*) FILTER (infinite OR missing) AS dropped,
  count(*) FILTER (infinite) AS dropped_inf, count(*) FILTER (missing) AS dropped_nan FROM t""",
    "describe_orders": describe("orders", ["o_orderkey", "o_custkey", "o_totalprice"]),
    "describe_lineitem_by_flag": describe("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag"),
    "pearson_lineitem": pearson("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "pearson_gaps": pearson("gaps", ["l_partkey", "l_quantity", "l_tax"], f"WITH {GAPS} "),
    "spearman_part": spearman("part", ["p_size", "p_retailprice"]),
    "spearman_gaps": spearman("gaps", ["l_partkey", "l_quantity", "l_tax"], f"WITH {GAPS} "),
    "value_counts_events": """SELECT 'event_type' AS "column", event_type AS value, count(*) AS count, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type""",
    "contingency_orders": "SELECT o_orderpriority AS value_a, o_orderstatus AS value_b, count(*) AS count FROM orders GROUP BY ALL",
    "histogram_events": """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events),
c AS (SELECT least(29, floor((value - lo) * 30 / (hi - lo)))::INTEGER AS bin, count(*) AS k FROM events, s GROUP BY ALL)
SELECT 'value' AS "column", bin, round(lo + bin * (hi - lo) / 30, 6) AS lo, round(lo + (bin + 1) * (hi - lo) / 30, 6) AS hi,
  coalesce(k, 0) AS count, round(coalesce(k, 0) * 30.0 / (n * (hi - lo)), 9) AS density
FROM (SELECT unnest(range(0, 30))::INTEGER AS bin) f LEFT JOIN c USING (bin), s""",
    "ecdf_part_size": """SELECT DISTINCT 'p_size' AS "column", p_size::DOUBLE AS x, round(cume_dist() OVER (ORDER BY p_size), 6) AS ecdf FROM part""",
    "box_events_by_type": """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, 'value' AS "column", round(min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_low,
  round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
  round(max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
  count(*) FILTER (NOT (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_outliers FROM events JOIN q USING (event_type) GROUP BY event_type""",
    "quantile_grid_orders": union([
        f"SELECT '{c}' AS \"column\", unnest(range(0, 11))::INTEGER AS i, round(unnest(quantile_cont({c}::DOUBLE, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])), 4) AS edge FROM orders"
        for c in ("o_totalprice", "o_custkey")]),
    "upper_median_orders": union([
        f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS value FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i = n // 2"
        for c in ("o_totalprice", "o_custkey")]),
    "normality_k2_orders": "WITH src0 AS (" + union([
        f"SELECT '{c}' AS \"column\", count(*) AS n, skewness({c}::DOUBLE) AS sk, kurtosis({c}::DOUBLE) AS ku FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice")
    ]) + """), src AS (SELECT "column", n, sk * (n - 2) / sqrt(n * (n - 1.0)) AS g1, (ku * (n - 2.0) * (n - 3) / (n - 1) - 6) / (n + 1) AS g2 FROM src0)
SELECT "column", n, round(k2, 3) AS statistic, round(exp(-k2 / 2), 6) AS p_value FROM (""" + k2("n", "g1", "g2") + ")",
    "ttest_flags": f"WITH {FLAGS_LONG}, {TWO_SAMPLE} SELECT \"column\", round({STUDENT_T}, 6) AS statistic, n1 + n2 - 2 AS df, round({student_two_sided(STUDENT_T, 'n1 + n2 - 2')}, 6) AS p_value FROM stats",
    "welch_flags": f"WITH {FLAGS_LONG}, {TWO_SAMPLE} SELECT \"column\", round(welch_t, 6) AS statistic, round(welch_df, 3) AS df, round({student_two_sided('welch_t', 'welch_df')}, 6) AS p_value FROM stats",
    "levene_flags": f"WITH {FLAGS_LONG}, {TWO_SAMPLE} SELECT \"column\", round(f, 6) AS statistic, d2 AS df, round({student_two_sided('sqrt(f)', 'd2')}, 6) AS p_value FROM stats",
    "cohens_d_flags": f"WITH {FLAGS_LONG}, {TWO_SAMPLE} SELECT \"column\", round({COHEN}, 6) AS effect_size, {cohen_label(COHEN)} AS effect_label FROM stats",
    "mannwhitney_flags": f"WITH {FLAGS_LONG}, {TWO_SAMPLE} SELECT \"column\", n_a, n_b, round(u, 1)::DOUBLE AS statistic, round({U_P}, 6) AS p_value, round({BISERIAL}, 6) AS effect_size, {biserial_label(BISERIAL)} AS effect_label FROM stats",
    "ks2_flags": f"WITH {FLAGS_LONG}, {TWO_SAMPLE}, l AS (SELECT *, d * sqrt(n1 * n2 / (n1 + n2)) AS lam FROM stats) SELECT \"column\", n_a, n_b, round(d, 6) AS statistic, round({kolmogorov('lam')}, 6) AS p_value FROM l",
    "compare_auto_flags": f"""WITH {FLAGS_LONG}, {TWO_SAMPLE}, {DECIDED}
SELECT "column", test, round(statistic, 4)::DOUBLE AS statistic, round(p_value, 6) AS p_value, 'k2' AS norm_test,
  round(k2_a, 3) AS norm_a_stat, round(exp(-k2_a / 2), 6) AS norm_a_p, round(k2_b, 3) AS norm_b_stat, round(exp(-k2_b / 2), 6) AS norm_b_p,
  round(f, 6) AS levene_stat, round(levene_p, 6) AS levene_p, round(effect_size, 6) AS effect_size,
  CASE test WHEN 'mann_whitney' THEN 'rank_biserial' ELSE 'cohens_d' END AS effect_metric,
  CASE test WHEN 'mann_whitney' THEN {biserial_label('effect_size')} ELSE {cohen_label('effect_size')} END AS effect_label,
  concat_ws('>', CASE WHEN ok_a AND ok_b THEN 'both_normal' WHEN ok_b THEN 'a_not_normal' WHEN ok_a THEN 'b_not_normal' ELSE 'both_not_normal' END,
    CASE test WHEN 'student' THEN 'equal_variance' WHEN 'welch' THEN 'unequal_variance' END, test) AS decision,
  n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(std_a, 4) AS std_a, round(std_b, 4) AS std_b FROM chosen""",
    "paired_orders": f"""WITH s AS (SELECT o_orderstatus, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM
  (SELECT o_orderstatus, o_totalprice - (o_totalprice * 0.999 + o_custkey) AS d FROM orders) GROUP BY ALL),
t AS (SELECT *, m / (sd / sqrt(n)) AS t FROM s)
SELECT o_orderstatus, 'o_totalprice / revised' AS "column", n, round(t, 6) AS statistic, round(abs(m / sd), 6) AS effect_size, round({student_two_sided('t', 'n - 1')}, 6) AS p_value FROM t""",
    "fdr_by_line": f"""SELECT l_linenumber, round(chi2, 6) AS chi2, round(p_value, 6) AS p_value, round(adj, 6) AS p_corrected, adj <= 0.05 AS rejected FROM (
  SELECT *, least(1.0, min(p_value * m / r) OVER (ORDER BY r DESC)) AS adj FROM (
    SELECT *, row_number() OVER (ORDER BY p_value) AS r, count(*) OVER () AS m FROM ({chi2('lineitem', 'l_linestatus', 'l_returnflag', 'exp(-chi2 / 2)', 'l_linenumber').format('chi2, p_value')})))""",
    "chi2_priority_status": chi2("orders", "o_orderpriority", "o_orderstatus", EVEN_8).format(CHI2_OUT),
    "chi2_two_by_two": chi2("(SELECT l_linestatus, l_returnflag = 'R' AS returned FROM lineitem)", "l_linestatus", "returned", normal_two_sided("sqrt(chi2)")).format(CHI2_OUT),
    "chi2_quality_toxic": chi2("(SELECT quality, toxic FROM documents JOIN labels USING (doc_id))", "quality", "toxic", normal_two_sided("sqrt(chi2)")).format(CHI2_OUT),
    "chi2_low_expected": chi2("(SELECT user_id, strftime(ts, '%Y-%m-%d %H') AS hour FROM events)", "user_id", "hour", "0").format(
        """round(chi2, 4) AS chi2, dof, n, round(v, 4) AS cramers_v, CASE WHEN v < 0.1 THEN 'none' WHEN v < 0.3 THEN 'weak' WHEN v < 0.5 THEN 'moderate' ELSE 'strong' END AS strength, low_expected_cells, total_cells"""),
    "fit_poisson_law_users": f"""WITH RECURSIVE c AS (SELECT user_id, count(*) AS x FROM events GROUP BY user_id),
st AS (SELECT count(*) AS n, avg(x) AS lam FROM c),
v AS (SELECT x, count(*) AS w, row_number() OVER (ORDER BY x) AS i, lead(x) OVER (ORDER BY x) AS nx FROM c GROUP BY x),
cells AS (SELECT v.*, CASE WHEN nx IS NULL THEN n ELSE n * list_sum(list_transform(range(0, nx), lambda k: exp(k * ln(lam) - lam - lgamma(k + 1)))) END
  - CASE WHEN i = 1 THEN 0 ELSE n * list_sum(list_transform(range(0, x), lambda k: exp(k * ln(lam) - lam - lgamma(k + 1)))) END AS e FROM v, st),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS o, CAST(0 AS DOUBLE) AS e UNION ALL
  SELECT cells.i, CASE WHEN walk.e >= 5 THEN 0 ELSE walk.o END + cells.w, CASE WHEN walk.e >= 5 THEN 0 ELSE walk.e END + cells.e
  FROM walk JOIN cells ON cells.i = walk.i + 1),
bins AS (SELECT *, i = max(i) OVER () AS last FROM walk WHERE e >= 5),
rest AS (SELECT coalesce(sum(o), 0) AS o, coalesce(sum(e), 0) AS e FROM walk WHERE e < 5 AND i > 0 AND i = (SELECT max(i) FROM walk)),
t AS (SELECT sum(pow(bins.o + if(last, rest.o, 0) - bins.e - if(last, rest.e, 0), 2) / (bins.e + if(last, rest.e, 0))) AS chi2, count(*) - 2 AS df FROM bins, rest)
SELECT 'events' AS "column", 'poisson' AS distribution, round(chi2, 6) AS statistic, round({chi2_upper("chi2", "df")}, 6) AS p_value, true AS is_best,
  CAST(NULL AS DOUBLE) AS p_s, CAST(NULL AS DOUBLE) AS p_loc, CAST(NULL AS DOUBLE) AS p_scale, round(lam, 6) AS p_lambda, 'ok' AS status FROM t, st WHERE df > 0""",
    "fit_distributions_by_type": f"""{fits("SELECT event_type AS k, value AS x FROM events WHERE NOT isnan(value)")}
{fit_rows("k AS event_type, 'value' AS \"column\"", ", top AS is_best")}""",
    "fit_poisson_users": f"""{fits("SELECT 'events' AS k, count(*)::DOUBLE AS x FROM events GROUP BY user_id")}
{fit_rows('k AS "column"', ", top AS is_best")}""",
    "best_fit_part": f"""{fits("SELECT 'p_size' AS k, p_size::DOUBLE AS x FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part")}
{fit_rows('k AS "column"')} WHERE top""",
    "fit_norm_expon_events": f"""WITH s AS (SELECT count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd, min(value) AS lo FROM events),
v AS (SELECT value, count(*) AS w FROM events GROUP BY value),
r AS (SELECT *, sum(w) OVER (ORDER BY value) AS cum FROM v),
t AS (SELECT cum::DOUBLE / n AS up, (cum - w)::DOUBLE / n AS low, {normal_cdf('(value - m) / sd')} AS fn, 1 - exp(-(value - lo) / (m - lo)) AS fe FROM r, s),
d AS (SELECT max(greatest(up - fn, fn - low)) AS dn, max(greatest(up - fe, fe - low)) AS de FROM t),
p AS (SELECT *, {kolmogorov('dn * sqrt(n)')} AS pn, {kolmogorov('de * sqrt(n)')} AS pe FROM d, s)
SELECT 'value' AS "column", 'norm' AS distribution, round(dn, 6) AS statistic, round(pn, 6) AS p_value, pn >= pe AS is_best,
  NULL::DOUBLE AS p_s, round(m, 6) AS p_loc, round(sd, 6) AS p_scale, NULL::DOUBLE AS p_lambda, 'ok' AS status FROM p
UNION ALL SELECT 'value', 'expon', round(de, 6), round(pe, 6), pe > pn, NULL, round(lo, 6), round(m - lo, 6), NULL, 'ok' FROM p""",
    "pdf_curve_events": """WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM events),
g AS (SELECT *, lo - (hi - lo) * 0.1 + i * ((hi + (hi - lo) * 0.1) - (lo - (hi - lo) * 0.1)) / 199 AS x FROM s, range(0, 200) r(i))
SELECT 'value' AS "column", 'norm' AS distribution, round(x, 6) AS x, round(exp(-0.5 * pow((x - m) / sd, 2)) / (sd * sqrt(2 * pi())), 9) AS y FROM g
UNION ALL SELECT 'value', 'expon', round(x, 6), round(CASE WHEN x < lo THEN 0.0 ELSE exp(-(x - lo) / (m - lo)) / (m - lo) END, 9) FROM g""",
    "drift_structure": f"""WITH {SIDES}, c AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)
SELECT na AS rows_base, nb AS rows_compare, nb - na AS rows_delta, round((nb - na) * 100.0::DOUBLE / na, 2) AS rows_delta_percent FROM c""",
    "drift_columns": """SELECT 'o_custkey' AS "column", 'added' AS change, NULL AS base_type, 'bigint' AS compare_type, NULL::BIGINT AS base_values, count(o_custkey) AS compare_values FROM orders
UNION ALL SELECT 'o_orderstatus', 'removed', 'string', NULL, count(o_orderstatus), NULL FROM orders
UNION ALL SELECT 'o_totalprice', 'type_changed', 'double', 'string', count(o_totalprice), count(o_totalprice) FROM orders""",
    "drift_quality": f"WITH {SIDES} " + union([
        f"""SELECT '{c}' AS "column", 0.0::DOUBLE AS missing_base_pct, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_compare_pct,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_delta_pct, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) > 5 AS degraded,
  {"(SELECT count(*) FROM " + fresh(c) + ")" if c in TEXTS else "0::BIGINT"} AS new_category_count,
  {"(SELECT coalesce(string_agg(v, '|' ORDER BY v), '') FROM (FROM " + fresh(c) + " ORDER BY v LIMIT 5))" if c in TEXTS else "''"} AS first_new_categories FROM b"""
        for c, _, _ in ORDERS_COLUMNS]),
    "drift_new_categories": f"WITH {SIDES} " + union([
        f"SELECT '{c}' AS \"column\", v AS value FROM (SELECT {c} AS v FROM b EXCEPT SELECT {c} FROM a)" for c in ("o_orderstatus", "o_orderpriority")]),
    "drift_psi": f"WITH {SIDES}, {SIDES_LONG}, {PSI} SELECT \"column\", round(psi, 6) AS psi, {PSI_LABEL} AS psi_label FROM psis",
    "drift_numeric": f"""WITH {SIDES}, {SIDES_LONG}, {TWO_SAMPLE}, {DECIDED}, {PSI}, {NUMERIC}
SELECT "column", n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(std_a, 4) AS std_a, round(std_b, 4) AS std_b,
  round(delta, 4) AS delta, round(delta * 100 / mean_a, 4) AS delta_percent, round(psi, 6) AS psi, {PSI_LABEL} AS psi_label,
  round(d, 6) AS ks_stat, round(ks_p, 6) AS ks_p, ks_p < 0.05 OR psi >= 0.2 AS shape_drifted, false AS is_paired, NULL::VARCHAR AS paired_cancelled_reason,
  test, round(statistic, 4)::DOUBLE AS statistic, round(p_value, 6) AS p_value, round(effect_size, 6) AS effect_size, round(p_corrected, 6) AS p_corrected, verdict FROM verdicts""",
    "drift_judged": f"""WITH {SIDES}, {SIDES_LONG}, {TWO_SAMPLE}, {DECIDED}, {PSI}, {NUMERIC}
SELECT "column", verdict, CASE verdict WHEN 'significant_small_effect' THEN 'minor' WHEN 'no_difference' THEN 'unchanged'
  WHEN 'significant_increase' THEN (CASE WHEN "column" = 'o_totalprice' THEN 'bad' ELSE 'good' END)
  WHEN 'significant_decrease' THEN (CASE WHEN "column" = 'o_totalprice' THEN 'good' ELSE 'bad' END) ELSE 'neutral' END AS judgement FROM verdicts""",
    "drift_categorical": f"WITH {SIDES}, long AS (" + union([
        f"SELECT '{c}' AS \"column\", {s} AS side, {c} AS v FROM {t}" for c in ("o_orderpriority", "o_orderstatus") for s, t in ((0, "a"), (1, "b"))
    ]) + f"""), t AS (SELECT "column", v, count(*) FILTER (side = 0) AS ca, count(*) FILTER (side = 1) AS cb FROM long GROUP BY ALL),
s AS (SELECT *, sum(ca) OVER w AS ta, sum(cb) OVER w AS tb FROM t WINDOW w AS (PARTITION BY "column")),
e AS (SELECT *, (ca + cb)::DOUBLE * ta / (ta + tb) AS ea, (ca + cb)::DOUBLE * tb / (ta + tb) AS eb FROM s),
x AS (SELECT "column", sum(pow(ca - ea, 2) / ea + pow(cb - eb, 2) / eb) AS chi2, count(*) - 1 AS dof, any_value(ta + tb) AS n,
  count(*) FILTER (ea < 5) + count(*) FILTER (eb < 5) AS low_expected_cells, 2 * count(*) AS total_cells FROM e GROUP BY "column"),
p AS (SELECT *, CASE dof WHEN 2 THEN exp(-chi2 / 2) WHEN 4 THEN exp(-chi2 / 2) * (1 + chi2 / 2)
  WHEN 5 THEN {normal_two_sided('sqrt(chi2)')} + 2 * exp(-chi2 / 2) / sqrt(2 * pi()) * (sqrt(chi2) + pow(chi2, 1.5) / 3) END AS p FROM x),
q AS (SELECT *, least(1.0, min(p * m / r) OVER (ORDER BY r DESC)) AS adj FROM (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p))
SELECT "column", round(chi2, 6) AS chi2, round(p, 6) AS p_value, round(adj, 6) AS p_corrected, dof, round(sqrt(chi2 / n), 6) AS cramers_v, low_expected_cells, total_cells, adj <= 0.05 AS drifted FROM q""",
    "drift_shares": f"WITH {SIDES}, long AS (" + union([
        f"SELECT '{c}' AS \"column\", {s} AS side, {c} AS value FROM {t}" for c in ("o_orderpriority", "o_orderstatus") for s, t in ((0, "a"), (1, "b"))
    ]) + """), t AS (SELECT "column", value, count(*) FILTER (side = 0) AS base_count, count(*) FILTER (side = 1) AS compare_count FROM long GROUP BY ALL)
SELECT *, round(base_count::DOUBLE / sum(base_count) OVER w, 6) AS base_share, round(compare_count::DOUBLE / sum(compare_count) OVER w, 6) AS compare_share
FROM t WINDOW w AS (PARTITION BY "column")""",
    "ols_lineitem": f"WITH {OLS}, terms AS (" + union([
        ols_term("const", "b0", "e0", "NULL::DOUBLE"), ols_term("l_quantity", "b1", "e1", "vif"), ols_term("l_discount", "b2", "e2", "vif"),
    ]) + """) SELECT term, round(coefficient, 5) AS coefficient, round(std_error, 5) AS std_error, round(t, 6) AS t, round(p_value, 6) AS p_value, round(vif, 6) AS vif,
  CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS stars FROM terms""",
    "ols_model_lineitem": f"""WITH {OLS}, q AS (SELECT *, 1 - sse / (n * vyy) AS r2, (n * vyy - sse) / 2 / s2 AS f, n * (ln(2 * pi()) + ln(sse / n) + 1) AS base FROM f3)
SELECT n::BIGINT AS n, 'ok' AS status, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS r2_adj,
  CASE WHEN r2 >= 0.9 THEN 'very_strong' WHEN r2 >= 0.7 THEN 'strong' WHEN r2 >= 0.5 THEN 'moderate' WHEN r2 >= 0.3 THEN 'weak' ELSE 'none' END AS r2_label,
  round(f, 5) AS f, round(pow(1 + 2 * f / (n - 3), -(n - 3) / 2), 6) AS f_p, round(base + 6, 3) AS aic, round(base + 3 * ln(n), 3) AS bic,
  vif > 10 AS multicollinear, n < 50 AS small_sample FROM q""",
    "durbin_watson_lineitem": f"""WITH {OLS}, e AS (SELECT l_extendedprice - b0 - b1 * l_quantity - b2 * l_discount AS e, {LINE_ORDER} FROM lineitem, f3),
d AS (SELECT e, e - lag(e) OVER (ORDER BY {LINE_ORDER}) AS de FROM e), w AS (SELECT sum(de * de) / sum(e * e) AS dw FROM d)
SELECT round(dw, 6) AS durbin_watson, CASE WHEN dw < 1.5 THEN 'positive' WHEN dw > 2.5 THEN 'negative' ELSE 'none' END AS dw_label FROM w""",
    "predict_lineitem": f"WITH {OLS} SELECT l_orderkey, l_linenumber, l_partkey, round(b0 + b1 * l_quantity + b2 * l_discount, 4) AS y_predicted, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_tax) - 1 AS position FROM lineitem, f3",
    "predictive_model_orders": """WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS slope, regr_intercept(o_totalprice, o_custkey) AS b0, regr_r2(o_totalprice, o_custkey) AS r2 FROM orders)
SELECT count(*) AS n, 'ok' AS status, 'ols' AS model, round(any_value(b0), 5) AS intercept, round(any_value(r2), 5) AS r2,
  round(sqrt(avg(pow(o_totalprice - b0 - slope * o_custkey, 2))), 5) AS rmse, round(avg(abs(o_totalprice - b0 - slope * o_custkey)), 5) AS mae, round(any_value(slope), 5) AS slope FROM orders, f""",
    "ci_band_orders": """WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS b1, regr_intercept(o_totalprice, o_custkey) AS b0, avg(o_custkey) AS mx, var_pop(o_custkey) AS vx, count(*)::DOUBLE AS n FROM orders),
s AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(mx) AS mx, any_value(vx) AS vx, any_value(n) AS n, sum(pow(o_totalprice - b0 - b1 * o_custkey, 2)) / (any_value(n) - 2) AS s2 FROM orders, f),
q AS (SELECT *, 1.959963984540054::DOUBLE AS z FROM s),
-- Student quantile by its expansion around the normal one
t AS (SELECT *, z + (pow(z, 3) + z) / (4 * (n - 2)) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * pow(n - 2, 2))
  + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(n - 2, 3))
  + (79 * pow(z, 9) + 776 * pow(z, 7) + 1482 * pow(z, 5) - 1920 * pow(z, 3) - 945 * z) / (92160 * pow(n - 2, 4)) AS tq FROM q),
b AS (SELECT o_orderkey, o_custkey, b0 + b1 * o_custkey AS y, tq * sqrt(s2 * (1 / n + pow(o_custkey - mx, 2) / (n * vx))) AS h FROM orders, t)
SELECT o_orderkey, o_custkey::DOUBLE AS x, round(y, 3) AS y_predicted, round(y - h, 3) AS ci_lower, round(y + h, 3) AS ci_upper FROM b""",
    "ridge_by_customer": """WITH m AS (SELECT o_custkey, count(*) AS n, avg(o_orderkey) AS mx, avg(o_totalprice) AS my, stddev_pop(o_orderkey) AS sx,
  covar_pop(o_orderkey, o_totalprice) AS cxy, var_pop(o_totalprice) AS vy FROM orders GROUP BY o_custkey),
b AS (SELECT *, CASE WHEN n < 3 THEN NULL WHEN n < 50 THEN n * cxy / sx / (n + 1) / sx ELSE cxy / (sx * sx) END AS slope FROM m),
e AS (SELECT o_custkey, avg(abs(o_totalprice - (my - slope * mx) - slope * o_orderkey)) AS mae, sqrt(avg(pow(o_totalprice - (my - slope * mx) - slope * o_orderkey, 2))) AS rmse
  FROM orders JOIN b USING (o_custkey) GROUP BY o_custkey)
SELECT o_custkey, n, CASE WHEN n < 3 THEN 'too_few_rows' ELSE 'ok' END AS status, CASE WHEN n < 3 THEN NULL WHEN n < 50 THEN 'ridge' ELSE 'ols' END AS model, round(my - slope * mx, 4) AS intercept, round(1 - rmse * rmse / vy, 4) AS r2,
  round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(slope, 4) + 0.0 AS slope FROM b JOIN e USING (o_custkey)""",
    "model_by_customer": f"""WITH m AS (SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 3 THEN regr_r2(o_totalprice, o_orderkey) END AS r2, var_pop(o_totalprice) AS vy FROM orders GROUP BY o_custkey),
q AS (SELECT *, (n - 2)::DOUBLE AS df, r2 / (1 - r2) * (n - 2) AS f, n * (ln(2 * pi()) + ln(vy * (1 - r2)) + 1) AS base FROM m)
SELECT o_custkey, n, CASE WHEN n < 3 THEN 'too_few_rows' ELSE 'ok' END AS status, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) + 0.0 AS r2_adj,
  CASE WHEN n < 3 THEN NULL WHEN r2 >= 0.9 THEN 'very_strong' WHEN r2 >= 0.7 THEN 'strong' WHEN r2 >= 0.5 THEN 'moderate' WHEN r2 >= 0.3 THEN 'weak' ELSE 'none' END AS r2_label,
  round(f, 3) AS f, CASE WHEN n >= 3 THEN round({student_two_sided('sqrt(f)', 'df')}, 6) END AS f_p, round(base + 4, 3) AS aic, round(base + 2 * ln(n), 3) AS bic,
  false AS multicollinear, n < 50 AS small_sample FROM q""",
    "preview_orders": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders LIMIT 10""",
    "ts_validate_orders": f"""WITH daily AS (SELECT 1 AS one, o_orderdate, sum(o_totalprice) AS total FROM orders GROUP BY ALL), {regularity('daily', 'one', 'o_orderdate')}
SELECT 'o_orderdate' AS date_column, 'total' AS value_column, {REGULAR_OUT}, 0::BIGINT AS missing_values, {ADVICE} FROM found""",
    "ts_validate_by_type": f"""WITH {DAILY_EVENTS}, {regularity('daily', 'event_type', 'day')}
SELECT event_type, 'day' AS date_column, 'total' AS value_column, {REGULAR_OUT}, 0::BIGINT AS missing_values, {ADVICE} FROM found""",
    "time_regularity_events": f"""WITH e AS (SELECT 'ts' AS date_column, ts FROM events), {regularity('e', 'date_column', 'ts')}
SELECT date_column, {REGULAR_OUT}, {ADVICE} FROM found""",
    "resample_daily_mean": f"""WITH c AS ({CALENDAR_D}), v AS (SELECT d, avg(round(o_totalprice * 100)) AS v FROM c LEFT JOIN orders ON o_orderdate = d GROUP BY d),
k AS (SELECT d, v, last_value(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER p AS d0, last_value(v IGNORE NULLS) OVER p AS v0,
  first_value(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER n AS d1, first_value(v IGNORE NULLS) OVER n AS v1 FROM v
  WINDOW p AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS date, round(coalesce(v, v0 + (v1 - v0) * date_diff('day', d0, d) / date_diff('day', d0, d1)), 4) AS value, v IS NULL AS was_filled FROM k""",
    "resample_daily_by_status": """WITH s AS (SELECT o_orderstatus, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY ALL),
c AS (SELECT o_orderstatus, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM s),
v AS (SELECT c.o_orderstatus, d, max(round(o_totalprice * 100)) AS v FROM c LEFT JOIN orders o ON o_orderdate = d AND o.o_orderstatus = c.o_orderstatus GROUP BY ALL)
SELECT o_orderstatus, strftime(d, '%Y-%m-%d %H:%M:%S') AS date, round(last_value(v IGNORE NULLS) OVER (PARTITION BY o_orderstatus ORDER BY d), 4) AS value, v IS NULL AS was_filled FROM v""",
    "resample_weekly_sum": """WITH c AS (SELECT unnest(generate_series((SELECT date_trunc('week', min(o_orderdate)) FROM orders), (SELECT date_trunc('week', max(o_orderdate)) FROM orders), INTERVAL 7 DAY)) AS w)
SELECT strftime(w + INTERVAL 6 DAY, '%Y-%m-%d %H:%M:%S') AS date, round(coalesce(sum(round(o_totalprice * 100)), 0), 4) AS value, false AS was_filled
FROM c LEFT JOIN orders ON date_trunc('week', o_orderdate) = w GROUP BY w""",
    "resample_monthly_median": """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS date, round(median(round(o_totalprice * 100)), 4) AS value, false AS was_filled FROM orders GROUP BY date_trunc('month', o_orderdate)""",
    "resample_quarter_end_min": """SELECT strftime(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH), '%Y-%m-%d 00:00:00') AS date, round(min(round(o_totalprice * 100)), 4) AS value, false AS was_filled FROM orders GROUP BY date_trunc('quarter', o_orderdate)""",
    "resample_report_orders": """SELECT count(*) AS rows_before, date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 AS rows_after,
  date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 - count(DISTINCT o_orderdate) AS filled_count, 'D' AS freq, 'mean' AS agg, 'interpolate' AS fill, 'ok' AS status FROM orders""",
    "future_index_by_type": f"""WITH {DAILY_EVENTS}, l AS (SELECT event_type, count(*) AS n, max(day) AS last FROM daily GROUP BY ALL)
SELECT event_type, s::INTEGER AS step, n + s - 1 AS "index", strftime(last + to_days(s::INTEGER), '%Y-%m-%d %H:%M:%S') AS date FROM l, range(1, 8) r(s)""",
    "forecast_metrics_orders": """WITH e AS (SELECT o_orderstatus, o_totalprice AS y, o_totalprice - (o_totalprice * 0.999 + o_custkey) AS e FROM orders)
SELECT o_orderstatus, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e / y)) * 100, 4) AS mape,
  CASE WHEN avg(abs(e / y)) < 0.1 THEN 'high' WHEN avg(abs(e / y)) < 0.2 THEN 'good' WHEN avg(abs(e / y)) < 0.5 THEN 'moderate' ELSE 'low' END AS mape_label FROM e GROUP BY ALL""",
    "describe_infinite": """WITH v AS (
  SELECT 'l_quantity' AS "column", CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN 'inf'::DOUBLE ELSE l_quantity END AS x FROM lineitem
  UNION ALL SELECT 'l_extendedprice', CASE WHEN l_linenumber = 6 THEN '-inf'::DOUBLE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END FROM lineitem)
SELECT "column", count(x) AS "count", round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(median(x), 6) AS median,
  round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS max FROM v GROUP BY ALL""",
    "box_outliers_by_type": """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY ALL)
SELECT event_type, 'value' AS "column", round(value, 6) AS x FROM events JOIN q USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""",
}


def signed_rank(source: str, by: str, column: str) -> str:
    """Wilcoxon signed-rank test of d per group."""
    return f"""WITH d AS (SELECT {by}, d FROM ({source}) WHERE d <> 0),
v AS (SELECT {by}, abs(d) AS x, count(*) AS w, count(*) FILTER (d > 0) AS up FROM d GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY {by} ORDER BY x) - (w - 1) / 2.0 AS rk FROM v),
s AS (SELECT {by}, sum(w)::DOUBLE AS n, sum(up * rk) AS plus, sum((w - up) * rk) AS minus, sum(pow(w::DOUBLE, 3) - w) AS ties FROM r GROUP BY {by}),
z AS (SELECT *, least(plus, minus) AS t FROM s),
q AS (SELECT *, (t - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM z)
SELECT {by}, '{column}' AS "column", n::BIGINT AS n, round(t, 1)::DOUBLE AS statistic, round({normal_two_sided('z')}, 6) AS p_value FROM q"""


ORACLES["wilcoxon_orders"] = signed_rank(
    "SELECT o_orderstatus, o_totalprice - (o_totalprice * 0.999 + o_custkey) AS d FROM orders", "o_orderstatus", "o_totalprice / revised")
ORACLES["wilcoxon_ties_lineitem"] = signed_rank(
    "SELECT l_linenumber, l_discount - l_tax AS d FROM lineitem", "l_linenumber", "l_discount / l_tax")

ORACLES["shapiro_by_flag"] = "WITH " + shapiro(union([
    f"SELECT l_returnflag, '{c}' AS \"column\", {c}::DOUBLE AS x FROM lineitem" for c in ("l_quantity", "l_extendedprice")]), 'l_returnflag, "column"') + """
SELECT l_returnflag, "column", n, round(w, 6) AS statistic, round(p, 6) AS p_value FROM sw"""
ORACLES["residual_normality_lineitem"] = f"WITH {OLS}, " + shapiro(
    "SELECT 1 AS one, l_extendedprice - b0 - b1 * l_quantity - b2 * l_discount AS x FROM lineitem, f3", "one") + """
SELECT round(w, 6) AS shapiro_w, round(p, 6) AS shapiro_p, p >= 0.05 AS reliable FROM sw"""
ORACLES["drift_paired"] = f"""WITH a AS (SELECT * FROM orders),
b AS (SELECT o_orderkey, o_custkey, o_totalprice * 0.999 + o_custkey AS o_totalprice FROM orders), {SIDES_LONG}, {TWO_SAMPLE}, {DECIDED}, {PSI},
diffs AS (SELECT 'o_custkey' AS "column", (a.o_custkey - b.o_custkey)::DOUBLE AS x FROM a JOIN b USING (o_orderkey)
  UNION ALL SELECT 'o_totalprice', a.o_totalprice - b.o_totalprice FROM a JOIN b USING (o_orderkey)),
{shapiro('SELECT * FROM diffs', '"column"')},
wv AS (SELECT "column", abs(x) AS v, count(*) AS w, count(*) FILTER (x > 0) AS up FROM diffs WHERE x <> 0 GROUP BY ALL),
wr AS (SELECT *, sum(w) OVER (PARTITION BY "column" ORDER BY v) - (w - 1) / 2.0 AS rk FROM wv),
ws AS (SELECT "column", sum(w)::DOUBLE AS n, sum(up * rk) AS plus, sum((w - up) * rk) AS minus, sum(pow(w::DOUBLE, 3) - w) AS ties FROM wr GROUP BY "column"),
wz AS (SELECT "column", least(plus, minus) AS t, (least(plus, minus) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM ws),
pt AS (SELECT sw.*, t AS w_stat, z AS wz, CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) END AS tt, CASE WHEN sd > 0 THEN abs(mean / sd) ELSE 0 END AS effect
  FROM sw LEFT JOIN wz USING ("column")),
pp AS (SELECT *, CASE WHEN p >= 0.05 THEN {student_two_sided('tt', 'n - 1')} ELSE {normal_two_sided('wz')} END AS pv FROM pt),
merged AS (SELECT c.* REPLACE (
  CASE WHEN pp."column" IS NULL THEN c.test WHEN pp.p >= 0.05 THEN 'paired_t' ELSE 'wilcoxon' END AS test,
  CASE WHEN pp."column" IS NULL THEN c.statistic WHEN pp.p >= 0.05 THEN pp.tt ELSE pp.w_stat END AS statistic,
  CASE WHEN pp."column" IS NULL THEN c.p_value WHEN pp.p >= 0.05 AND pp.tt IS NULL THEN NULL ELSE pp.pv END AS p_value,
  CASE WHEN pp."column" IS NULL THEN c.effect_size ELSE pp.effect END AS effect_size), pp."column" IS NOT NULL AS is_paired
  FROM chosen c LEFT JOIN pp ON c."column" = pp."column"),
ranked AS (SELECT *, row_number() OVER (ORDER BY p_value NULLS LAST) AS r, count(p_value) OVER () AS m FROM merged JOIN psis USING ("column")),
adjusted AS (SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1.0, min(p_value * m / r) OVER (ORDER BY r DESC)) END AS p_corrected,
  d * sqrt(n1 * n2 / (n1 + n2)) AS lam, mean_b - mean_a AS delta FROM ranked),
drifted AS (SELECT *, {kolmogorov('lam')} AS ks_p FROM adjusted)
SELECT "column", n_a, n_b, round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(std_a, 4) AS std_a, round(std_b, 4) AS std_b,
  round(delta, 4) AS delta, round(delta * 100 / mean_a, 4) AS delta_percent, round(psi, 6) AS psi, {PSI_LABEL} AS psi_label,
  round(d, 6) AS ks_stat, round(ks_p, 6) AS ks_p, ks_p < 0.05 OR psi >= 0.2 AS shape_drifted, is_paired, NULL::VARCHAR AS paired_cancelled_reason,
  test, round(statistic, 4)::DOUBLE AS statistic, round(p_value, 6) AS p_value, round(effect_size, 6) AS effect_size, round(p_corrected, 6) AS p_corrected,
  CASE WHEN p_value IS NULL OR p_corrected > 0.05 OR p_value >= 0.05 THEN 'no_difference' WHEN abs(effect_size) < 0.2 THEN 'significant_small_effect'
    WHEN delta > 0 THEN 'significant_increase' WHEN delta < 0 THEN 'significant_decrease' ELSE 'significant_difference' END AS verdict FROM drifted"""


def holt(select: str) -> str:
    """Holt's linear trend per event type: grid rounds of 11, 7 and 7, the start state solved from the normal equations."""
    ctes = ["""s AS (SELECT event_type, day, total AS y, row_number() OVER (PARTITION BY event_type ORDER BY day) AS t FROM (
  SELECT event_type, date_trunc('day', ts) AS day, sum(value) AS total FROM events GROUP BY ALL))""",
            "b0 AS (SELECT DISTINCT event_type, 0.5::DOUBLE AS a, 0.5::DOUBLE AS g, 0.5::DOUBLE AS half FROM s)"]
    for k, size in enumerate((11, 7, 7), 1):
        axis = f"least(0.9999, greatest(0.0001, {{c}} - half + 2 * half * {{i}} / {size - 1}.0))::DOUBLE"
        ctes += [f"""w{k} AS (SELECT event_type, {axis.format(c='a', i='i')} AS a, {axis.format(c='g', i='j')} AS g, 2 * half / {size - 1} AS half, CAST(0 AS BIGINT) AS t,
    1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p10, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS r0, 0.0::DOUBLE AS r1,
    0.0::DOUBLE AS h00, 0.0::DOUBLE AS h01, 0.0::DOUBLE AS h11, 0.0::DOUBLE AS q0, 0.0::DOUBLE AS q1, 0.0::DOUBLE AS k FROM b{k - 1}, range({size}) x(i), range({size}) z(j)
  UNION ALL SELECT event_type, a, g, half, t, u0 * (1 - a), u1 * (1 - a), p10 - a * g * u0, p11 - a * g * u1, r0 + r1 + a * c, r1 + a * g * c,
    h00 + u0 * u0, h01 + u0 * u1, h11 + u1 * u1, q0 + u0 * c, q1 + u1 * c, k + c * c
  FROM (SELECT w.* EXCLUDE (t), s.t, p00 + p10 AS u0, p01 + p11 AS u1, y - r0 - r1 AS c FROM w{k} w JOIN s ON s.event_type = w.event_type AND s.t = w.t + 1))""",
                 f"""e{k} AS (SELECT *, (q0 * h11 - q1 * h01) / (h00 * h11 - h01 * h01) AS l, (h00 * q1 - h01 * q0) / (h00 * h11 - h01 * h01) AS b
  FROM w{k} WHERE t = (SELECT max(t) FROM s WHERE s.event_type = w{k}.event_type))""",
                 f"b{k} AS (SELECT * FROM e{k} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY k - q0 * l - q1 * b, a, g) = 1)"]
    ctes += ["m AS (SELECT event_type, t AS n, a, g, l, b, p00 * l + p01 * b + r0 AS level, p10 * l + p11 * b + r1 AS trend FROM b3)",
             """walk AS (SELECT event_type, a, g, CAST(0 AS BIGINT) AS t, l, b, 0.0::DOUBLE AS y, 0.0::DOUBLE AS e FROM m UNION ALL
  SELECT w.event_type, a, g, s.t, l + b + a * (s.y - l - b), b + a * g * (s.y - l - b), s.y, s.y - l - b FROM walk w JOIN s ON s.event_type = w.event_type AND s.t = w.t + 1)"""]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


ORACLES["holt_by_event_type"] = holt("""SELECT m.event_type, CAST(step AS INTEGER) AS step, n + step - 1 AS "index", strftime(last + to_days(CAST(step AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS date,
  round(level + step * trend, 3) AS forecast, NULL::DOUBLE AS ci_lower, NULL::DOUBLE AS ci_upper
FROM m JOIN (SELECT event_type, max(day) AS last FROM s GROUP BY event_type) USING (event_type), range(1, 8) r(step)""")
ORACLES["holt_model_by_event_type"] = holt("""SELECT m.event_type, 'holt' AS model, round(any_value(m.a), 4) AS alpha, round(any_value(m.g), 4) AS beta,
  round(any_value(level), 3) AS level, round(any_value(trend), 3) AS trend, NULL::DOUBLE AS aic, round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse,
  round(100 * avg(abs(e / y)) FILTER (y <> 0), 3) AS mape, 'ok' AS status FROM m JOIN walk USING (event_type) WHERE walk.t > 0 GROUP BY m.event_type""")
ORACLES["compare_datasets"] = f"""SELECT 'numeric' AS section, "column", verdict FROM ({ORACLES["drift_numeric"]})
UNION ALL SELECT 'categorical', "column", CASE WHEN drifted THEN 'drifted' ELSE 'stable' END FROM ({ORACLES["drift_categorical"]})
UNION ALL SELECT 'quality', "column", coalesce(first_new_categories, '') FROM ({ORACLES["drift_quality"]})"""
ORACLES["pdf_curve_by_type"] = f"""{fits("SELECT event_type AS k, value AS x FROM events WHERE NOT isnan(value)")},
c AS (SELECT best.*, st.lo - 0.1 * (st.hi - st.lo) + i * 1.2 * (st.hi - st.lo) / 19 AS x FROM best JOIN st USING (k), range(0, 20) q(i))
SELECT k AS event_type, 'value' AS "column", law AS distribution, round(x, 6) AS x, round(CASE law
  WHEN 'norm' THEN exp(-0.5 * pow((x - loc) / scale, 2)) / (scale * sqrt(2 * pi()))
  WHEN 'expon' THEN CASE WHEN x < loc THEN 0 ELSE exp(-(x - loc) / scale) / scale END
  ELSE CASE WHEN x <= loc THEN 0 ELSE exp(-0.5 * pow(ln((x - loc) / scale) / s, 2)) / (s * (x - loc) * sqrt(2 * pi())) END END, 9) AS y FROM c"""
