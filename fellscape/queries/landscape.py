"""Queries of the landscape features, one per feature, over the parts samples (two responses)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fellscape.functions.columns import tidy
from fellscape.operators import quantile, rescale, sample
from fellscape.operators.features import cells, dispersion, distribution, levels, linear, neighbours, walk
from fellscape.operators.rescale import Bounds
from fellscape.queries import views as v
from fellscape.queries.registry import add
from fellscape.session import cut

X = ["x1", "x2"]
Y = v.RESPONSES
BOX = Bounds.cube(X)
BASE = f"WITH {v.POINTS}"


def frame(spark, sf):
    """Normalised samples with every row as repeat 0, and their number."""
    points = cut(rescale.normalize_response(sample.full_sample(v.points(spark, sf)), ["rep"], Y, bound=1))
    return points, points.count()


FAMILIES = {
    "ela_meta": lambda p, n: linear.linear_features(p, X, Y, BOX, ("meta",)),
    "pca": lambda p, n: linear.linear_features(p, X, Y, BOX, ("pca",)),
    "ela_distr": lambda p, n: distribution.distribution_features(p, Y, bound=len(Y)),
    "ela_level": lambda p, n: levels.level_features(p, X, Y, bound=len(Y)),
    "limo": lambda p, n: cells.limo_features(p, X, Y, BOX),
    "nbc": lambda p, n: neighbours.nbc_features(p, X, Y, n),
    "disp": lambda p, n: dispersion.dispersion_features(p, X, Y, BOX, n, [0], bound=1),
    "ic": lambda p, n: walk.walk_features(p, X, Y, n),
}


def feature(name):
    family = name.split(".")[0]

    def run(spark, sf):
        points, n = frame(spark, sf)
        rows = FAMILIES[family](points, n)
        return rows.where(F.col("feature") == name).select("label", "feature", tidy("value").alias("value"))
    return run


def register(name, ctes=None, value=None, source=None):
    """``value`` is an SQL expression over ``source``, one row per label."""
    sql = None
    if value:
        sql = f"{BASE}{', ' + ctes if ctes else ''} SELECT label, '{name}' AS feature, {v.t(value)} AS value FROM {source}"
    add(name, feature(name), sql)


# ---- regression fits: each model by orthogonal columns, one regressor after the other ---------------

FULL = ["x1", "x2", "x1 * x1", "x2 * x2", "x1 * x2", "x1 * x1 * x1", "x1 * x2 * x2", "x2 * x1 * x1", "x2 * x2 * x2", "x1 * x1 * x2 * x2"]


def orthogonal(tag, regs):
    """CTEs ending in ``tag``: per label the fit and the coefficient of the last regressor."""
    w = "OVER (PARTITION BY label)"
    out = [f"{tag}_0 AS (SELECT label, y - avg(y) {w} AS t, "
           + ", ".join(f"{r} - avg({r}) {w} AS r{k}" for k, r in enumerate(regs)) + " FROM samples)"]
    for k in range(len(regs)):
        less = "".join(f" - q{j} * sum(r{k} * q{j}) {w} / sum(q{j} * q{j}) {w}" for j in range(k))
        out.append(f"{tag}_{k + 1} AS (SELECT *, r{k}{less} AS q{k} FROM {tag}_{k})")
    p = len(regs)
    share = " + ".join(f"sum(t * q{k}) ** 2 / sum(q{k} * q{k})" for k in range(p))
    out.append(f"{tag} AS (SELECT label, count(*) AS n, ({share}) / sum(t * t) AS r2, sum(t * q{p - 1}) / sum(q{p - 1} * q{p - 1}) AS last_coef "
               f"FROM {tag}_{p} GROUP BY label)")
    return ", ".join(out)


def adj(p):
    return f"1 - (1 - r2) * (n - 1) / (n - {p} - 1)"


SLOPES = """ols AS (SELECT label, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x1, x2) AS c12, var_pop(x1) AS v1, var_pop(x2) AS v2,
avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM samples GROUP BY label),
slopes AS (SELECT label, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2, m1, m2, my FROM ols)"""
register("ela_meta.lin_simple.adj_r2", orthogonal("fit", ["x1", "x2"]), adj(2), "fit")
register("ela_meta.lin_simple.intercept", SLOPES, "my - b1 * m1 - b2 * m2", "slopes")
register("ela_meta.lin_simple.coef.min", SLOPES, "least(abs(b1), abs(b2))", "slopes")
register("ela_meta.lin_simple.coef.max", SLOPES, "greatest(abs(b1), abs(b2))", "slopes")
register("ela_meta.lin_simple.coef.max_by_min", SLOPES, "greatest(abs(b1), abs(b2)) / least(abs(b1), abs(b2))", "slopes")
register("ela_meta.lin_w_interact.adj_r2", orthogonal("fit", ["x1", "x2", "x1 * x2"]), adj(3), "fit")
register("ela_meta.quad_simple.adj_r2", orthogonal("fit", ["x1", "x2", "x1 * x1", "x2 * x2"]), adj(4), "fit")
register("ela_meta.quad_simple.cond",
         orthogonal("one", ["x1", "x2", "x2 * x2", "x1 * x1"]) + ", " + orthogonal("two", ["x1", "x2", "x1 * x1", "x2 * x2"])
         + ", pair AS (SELECT label, abs(one.last_coef) AS a, abs(two.last_coef) AS b FROM one JOIN two USING (label))",
         "greatest(a, b) / least(a, b)", "pair")
register("ela_meta.quad_w_interact.adj_r2", orthogonal("fit", FULL), adj(10), "fit")

# ---- distribution -------------------------------------------------------------------------------------------

MOMENTS = """mo AS (SELECT label, y, y - avg(y) OVER (PARTITION BY label) AS e FROM samples),
ms AS (SELECT label, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM mo GROUP BY label)"""
register("ela_distr.skewness", MOMENTS, "m3 / m2 ** 1.5", "ms")
register("ela_distr.kurtosis", MOMENTS, "m4 / (m2 * m2) - 3", "ms")


def peaks_sql(source, keys="label", y="y"):
    """Binned kernel density, hills between minima, hills with a top and enough mass."""
    root = math.sqrt(2 * math.pi)
    return f"""st AS (SELECT {keys}, count({y}) AS n, min({y}) AS lo, max({y}) AS hi, stddev_samp({y}) AS sd,
  quantile_cont({y}, 0.75) - quantile_cont({y}, 0.25) AS iqr FROM {source} GROUP BY {keys}),
sh AS (SELECT *, 0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr / 1.34) ELSE sd END * n ** -0.2 AS h FROM st),
bn AS (SELECT {keys}, n, lo, hi, h, least(1023, floor(({y} - lo) / ((hi - lo) / 1024))) AS bin, count(*) AS c
  FROM {source} JOIN sh USING ({keys}) GROUP BY ALL),
dn AS (SELECT {keys}, g, any_value((hi - lo + 6 * h) / 511) AS step,
  sum(c * exp(-0.5 * (((lo - 3 * h + (hi - lo + 6 * h) * g / 511) - (lo + (bin + 0.5) * (hi - lo) / 1024)) / h) ** 2) / (h * {root!r})) / any_value(n) AS f
  FROM bn, (SELECT unnest(range(512)) AS g) GROUP BY {keys}, g),
mk AS (SELECT *, coalesce(f < lag(f) OVER w AND f <= lead(f) OVER w, false) AS low,
  f > coalesce(lag(f) OVER w, -1) AND f >= coalesce(lead(f) OVER w, -1) AS top FROM dn WINDOW w AS (PARTITION BY {keys} ORDER BY g)),
hl AS (SELECT *, sum(low::INTEGER) OVER (PARTITION BY {keys} ORDER BY g) AS hill FROM mk),
hm AS (SELECT {keys}, hill, sum(f * step) AS mass, bool_or(top) AS top FROM hl GROUP BY ALL),
pk AS (SELECT {keys}, count(CASE WHEN mass >= 0.1 AND top THEN 1 END) AS peaks FROM hm GROUP BY {keys})"""


register("ela_distr.number_of_peaks", peaks_sql("samples"), "peaks", "pk")
_EVENTS = "ev AS (SELECT event_type AS label, value AS y FROM events)"


def _events(spark, sf):
    return v.table(spark, sf, "events").select(F.col("event_type").alias("label"), F.col("value").alias("y"))


add("distribution_by_label", lambda spark, sf: distribution.moments(_events(spark, sf), ["label"], "y")
    .select("label", tidy("ela_distr.skewness").alias("skewness"), tidy("ela_distr.kurtosis").alias("kurtosis")),
    f"""WITH {_EVENTS}, mo AS (SELECT label, y - avg(y) OVER (PARTITION BY label) AS e FROM ev),
ms AS (SELECT label, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM mo GROUP BY label)
SELECT label, {v.t('m3 / m2 ** 1.5')} AS skewness, {v.t('m4 / (m2 * m2) - 3')} AS kurtosis FROM ms""")
add("peaks_by_label", lambda spark, sf: distribution.peaks(_events(spark, sf), ["label"], "y"),
    f"WITH {_EVENTS}, {peaks_sql('ev')} SELECT label, peaks::DOUBLE AS n_peaks FROM pk")
add("exact_quantiles", lambda spark, sf: quantile.exact_quantiles(_events(spark, sf), ["label"], "y", [0.0, 0.02, 0.25, 0.5, 0.9, 1.0])
    .select("label", "prob", tidy("q").alias("q")),
    f"""WITH {_EVENTS}, q AS (SELECT label, unnest([0.0, 0.02, 0.25, 0.5, 0.9, 1.0])::DOUBLE AS prob,
unnest(quantile_cont(y, [0.0, 0.02, 0.25, 0.5, 0.9, 1.0])) AS q FROM ev GROUP BY label) SELECT label, prob, {v.t('q')} AS q FROM q""")

# ---- level sets ---------------------------------------------------------------------------------------------

LEVELS = """cuts AS (SELECT label, unnest([0.1, 0.25, 0.5]) AS p, unnest(quantile_cont(y, [0.1, 0.25, 0.5])) AS q FROM samples GROUP BY label),
lv AS (SELECT label, p, CAST('0x' || substr(md5(concat('fold:', sample_id)), 1, 6) AS BIGINT) % 10 AS fold,
  CASE WHEN y < q THEN 1 ELSE 0 END AS low, x1, x2 FROM samples JOIN cuts USING (label)),
sm AS (SELECT f.fold, l.label, l.p, l.low, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_samp(x1) AS v1, var_samp(x2) AS v2, covar_samp(x1, x2) AS c
  FROM lv l JOIN (SELECT unnest(range(10)) AS fold) f ON l.fold <> f.fold GROUP BY ALL),
two AS (SELECT a.fold, a.label, a.p, a.n AS na, b.n AS nb, a.m1 AS a1, a.m2 AS a2, b.m1 AS b1, b.m2 AS b2,
  a.v1 AS av1, a.v2 AS av2, a.c AS ac, b.v1 AS bv1, b.v2 AS bv2, b.c AS bc,
  ((a.n - 1) * a.v1 + (b.n - 1) * b.v1) / (a.n + b.n - 2) AS w1, ((a.n - 1) * a.v2 + (b.n - 1) * b.v2) / (a.n + b.n - 2) AS w2,
  ((a.n - 1) * a.c + (b.n - 1) * b.c) / (a.n + b.n - 2) AS wc
  FROM sm a JOIN sm b USING (fold, label, p) WHERE a.low = 1 AND b.low = 0),
sc AS (SELECT label, p, fold, low,
  -0.5 * ((x1 - a1) ** 2 * w2 - 2 * (x1 - a1) * (x2 - a2) * wc + (x2 - a2) ** 2 * w1) / (w1 * w2 - wc * wc) + ln(na / (na + nb))
  + 0.5 * ((x1 - b1) ** 2 * w2 - 2 * (x1 - b1) * (x2 - b2) * wc + (x2 - b2) ** 2 * w1) / (w1 * w2 - wc * wc) - ln(nb / (na + nb)) AS lda,
  -0.5 * ln(av1 * av2 - ac * ac) - 0.5 * ((x1 - a1) ** 2 * av2 - 2 * (x1 - a1) * (x2 - a2) * ac + (x2 - a2) ** 2 * av1) / (av1 * av2 - ac * ac) + ln(na / (na + nb))
  + 0.5 * ln(bv1 * bv2 - bc * bc) + 0.5 * ((x1 - b1) ** 2 * bv2 - 2 * (x1 - b1) * (x2 - b2) * bc + (x2 - b2) ** 2 * bv1) / (bv1 * bv2 - bc * bc) - ln(nb / (na + nb)) AS qda
  FROM lv JOIN two USING (label, p, fold)),
er AS (SELECT label, p, fold, avg(CASE WHEN (lda >= 0) <> (low = 1) THEN 1.0 ELSE 0.0 END) AS lda,
  avg(CASE WHEN (qda >= 0) <> (low = 1) THEN 1.0 ELSE 0.0 END) AS qda FROM sc GROUP BY ALL),
lq AS (SELECT label, p, avg(lda) AS lda, avg(qda) AS qda FROM er GROUP BY label, p)"""
for _p in (10, 25, 50):
    for _name, _value in (("mmce_lda", "lda"), ("mmce_qda", "qda"), ("lda_qda", "lda / nullif(qda, 0)")):
        register(f"ela_level.{_name}_{_p}", LEVELS, _value, f"lq WHERE p = {_p / 100}")

# ---- principal components -----------------------------------------------------------------------------------------


def eigen_sql(how):
    """Eigenvalues of the symmetric 2 x 2 (inputs) and 3 x 3 (with the response) matrix, in closed form."""
    cov = """mt AS (SELECT label, var_samp(x1) AS a, var_samp(x2) AS b, var_samp(y) AS c, covar_samp(x1, x2) AS d, covar_samp(x1, y) AS e,
covar_samp(x2, y) AS f FROM samples GROUP BY label)"""
    if how == "cor":
        cov += ", mx AS (SELECT label, 1.0 AS a, 1.0 AS b, 1.0 AS c, d / sqrt(a * b) AS d, e / sqrt(a * c) AS e, f / sqrt(b * c) AS f FROM mt)"
    else:
        cov += ", mx AS (SELECT * FROM mt)"
    return cov + """,
e2 AS (SELECT label, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + d * d) AS l1, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + d * d) AS l2, a + b AS tr FROM mx),
t1 AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS s FROM mx),
t2 AS (SELECT *, least(1, greatest(-1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * s ** 3))) AS r FROM t1),
e3 AS (SELECT label, q + 2 * s * cos(acos(r) / 3) AS l1, 3 * q - (q + 2 * s * cos(acos(r) / 3)) - (q + 2 * s * cos(acos(r) / 3 + 2 * pi() / 3)) AS l2, a + b + c AS tr FROM t2)"""


for _how in ("cov", "cor"):
    register(f"pca.expl_var.{_how}_x", eigen_sql(_how), "CASE WHEN l1 / tr >= 0.9 THEN 0.5 ELSE 1.0 END", "e2")
    register(f"pca.expl_var_PC1.{_how}_x", eigen_sql(_how), "l1 / tr", "e2")
    register(f"pca.expl_var.{_how}_init", eigen_sql(_how),
             "CASE WHEN l1 / tr >= 0.9 THEN 1 / 3.0 WHEN (l1 + l2) / tr >= 0.9 THEN 2 / 3.0 ELSE 1.0 END", "e3")
    register(f"pca.expl_var_PC1.{_how}_init", eigen_sql(_how), "l1 / tr", "e3")

# ---- cell-wise linear models ---------------------------------------------------------------------------------------------

LIMO = """ce AS (SELECT label, least(1, floor((x1 + 5) / 10 * 2)) * 2 + least(1, floor((x2 + 5) / 10 * 2)) AS cell, covar_pop(x1, y) AS c1,
  covar_pop(x2, y) AS c2, covar_pop(x1, x2) AS c12, var_pop(x1) AS v1, var_pop(x2) AS v2 FROM samples GROUP BY ALL HAVING count(*) >= 4),
cb AS (SELECT label, cell, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM ce),
cl AS (SELECT *, sqrt(b1 * b1 + b2 * b2) AS len, b1 / sqrt(b1 * b1 + b2 * b2) AS u1, b2 / sqrt(b1 * b1 + b2 * b2) AS u2,
  greatest(abs(b1), abs(b2)) / nullif(least(abs(b1), abs(b2)), 0) AS ratio FROM cb),
cc AS (SELECT a.label, avg(sign(a.b1 - a.b2) * sign(b.b1 - b.b2)) AS r FROM cl a JOIN cl b ON a.label = b.label AND a.cell < b.cell GROUP BY a.label),
lm AS (SELECT label, sqrt(avg(b1) ** 2 + avg(b2) ** 2) AS avg_length_reg, sqrt(avg(u1) ** 2 + avg(u2) ** 2) AS avg_length_norm,
  avg(len) AS length_mean, stddev_samp(len) AS length_sd, avg(ratio) AS ratio_mean, stddev_samp(ratio) AS ratio_sd,
  greatest(stddev_samp(b1), stddev_samp(b2)) / least(stddev_samp(b1), stddev_samp(b2)) AS sd_ratio_reg,
  greatest(stddev_samp(u1), stddev_samp(u2)) / least(stddev_samp(u1), stddev_samp(u2)) AS sd_ratio_norm,
  (stddev_samp(b1) + stddev_samp(b2)) / 2 AS sd_mean_reg, (stddev_samp(u1) + stddev_samp(u2)) / 2 AS sd_mean_norm,
  any_value(r) AS cor_reg, any_value(r) AS cor_norm FROM cl JOIN cc USING (label) GROUP BY label)"""
for _name in cells.LIMO:
    register(f"limo.{_name}", LIMO, _name, "lm")

# ---- nearest better -------------------------------------------------------------------------------------------------------------

NBC = """nn AS (SELECT a.sample_id, min(sqrt((a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2)) AS nn FROM norm a JOIN norm b ON a.sample_id <> b.sample_id GROUP BY ALL),
nb AS (SELECT a.label, a.sample_id, min(row(sqrt((a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2), b.sample_id)) AS best
  FROM samples a JOIN samples b ON a.label = b.label AND b.y < a.y GROUP BY ALL),
both_d AS (SELECT s.label, s.sample_id, nn, best[1] AS nb, best[2] AS nb_id FROM samples s JOIN nn USING (sample_id) LEFT JOIN nb ON nb.label = s.label AND nb.sample_id = s.sample_id),
nbc AS (SELECT label, stddev_samp(nn) / nullif(stddev_samp(nb), 0) AS sd_ratio, avg(nn) / nullif(avg(nb), 0) AS mean_ratio,
  corr(nn, nb) AS cor, stddev_samp(nn / nb) / nullif(avg(nn / nb), 0) AS coeff_var FROM both_d GROUP BY label),
deg AS (SELECT label, nb_id AS sample_id, count(*) AS k FROM both_d WHERE nb_id IS NOT NULL GROUP BY ALL),
fitn AS (SELECT s.label, corr(coalesce(k, 0), y) AS cor FROM samples s LEFT JOIN deg ON deg.label = s.label AND deg.sample_id = s.sample_id GROUP BY s.label)"""
register("nbc.nn_nb.sd_ratio", NBC, "sd_ratio", "nbc")
register("nbc.nn_nb.mean_ratio", NBC, "mean_ratio", "nbc")
register("nbc.nn_nb.cor", NBC, "cor", "nbc")
register("nbc.dist_ratio.coeff_var", NBC, "coeff_var", "nbc")
register("nbc.nb_fitness.cor", NBC, "cor", "fitn")

# ---- dispersion -------------------------------------------------------------------------------------------------------------------

DISP = """ap AS (SELECT avg(d) AS mean, median(d) AS median FROM (SELECT sqrt((a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2) AS d
  FROM norm a JOIN norm b ON a.sample_id < b.sample_id)),
cu AS (SELECT label, unnest([0.02, 0.05, 0.1, 0.25]) AS p, unnest(quantile_cont(y, [0.02, 0.05, 0.1, 0.25])) AS q FROM samples GROUP BY label),
be AS (SELECT label, p, sample_id, x1, x2 FROM samples JOIN cu USING (label) WHERE y <= q),
bp AS (SELECT a.label, a.p, avg(sqrt((a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2)) AS bmean, median(sqrt((a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2)) AS bmedian
  FROM be a JOIN be b ON a.label = b.label AND a.p = b.p AND a.sample_id < b.sample_id GROUP BY ALL),
ds AS (SELECT * FROM bp, ap)"""
for _q in (2, 5, 10, 25):
    for _what in ("mean", "median"):
        register(f"disp.ratio_{_what}_{_q:02d}", DISP, f"b{_what} / nullif({_what}, 0)", f"ds WHERE p = {_q / 100}")
        register(f"disp.diff_{_what}_{_q:02d}", DISP, f"b{_what} - {_what}", f"ds WHERE p = {_q / 100}")

# ---- information content -------------------------------------------------------------------------------------------------------------

IC = """wk AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('100:', sample_id)), sample_id) AS pos, x1, x2, y FROM samples),
sl AS (SELECT label, pos, (lead(y) OVER w - y) / sqrt((lead(x1) OVER w - x1) ** 2 + (lead(x2) OVER w - x2) ** 2) AS r FROM wk WINDOW w AS (PARTITION BY label ORDER BY pos)),
ep AS (SELECT 0 AS e, 0.0::DOUBLE AS eps UNION ALL SELECT k + 1, 10.0::DOUBLE ** (-5 + 20 * k / 999.0::DOUBLE) FROM (SELECT unnest(range(1000)) AS k)),
sy AS (SELECT label, e, eps, pos, CASE WHEN abs(r) > eps THEN sign(r) ELSE 0 END AS s FROM sl, ep WHERE r IS NOT NULL),
sq AS (SELECT *, lead(s) OVER (PARTITION BY label, e ORDER BY pos) AS s2 FROM sy),
pc AS (SELECT label, e, eps, s, s2, count(*) AS c, sum(count(*)) OVER (PARTITION BY label, e) AS tot FROM sq WHERE s2 IS NOT NULL GROUP BY label, e, eps, s, s2),
en AS (SELECT label, e, eps, sum(CASE WHEN s <> s2 THEN -(c / tot) * ln(c / tot) / ln(6) ELSE 0 END) AS h FROM pc GROUP BY label, e, eps),
nz AS (SELECT label, e, s, lag(s) OVER (PARTITION BY label, e ORDER BY pos) AS before FROM sy WHERE s <> 0),
st AS (SELECT label, count(*) AS steps FROM sl WHERE r IS NOT NULL GROUP BY label),
mm AS (SELECT label, e, eps, coalesce(runs, 0) / steps::DOUBLE AS m FROM ep CROSS JOIN st LEFT JOIN
  (SELECT label, e, count(CASE WHEN before IS NULL OR before <> s THEN 1 END) AS runs FROM nz GROUP BY label, e) USING (label, e))"""
register("ic.h_max", IC, "max(h)", "en GROUP BY label")
register("ic.eps_s", IC, "log10(min(CASE WHEN h < 0.05 AND e > 0 THEN eps END))", "en GROUP BY label HAVING max(CASE WHEN e = 0 THEN h END) >= 0.05")
register("ic.eps_max", IC, "eps", "(SELECT label, eps FROM en QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(h, 12) DESC, e) = 1)")
register("ic.m0", IC, "m", "mm WHERE e = 0")
register("ic.eps_ratio", IC, "log10(max(CASE WHEN mm.m > 0.5 * z.m AND mm.e > 0 THEN mm.eps END))",
         "mm JOIN (SELECT label, m FROM mm WHERE e = 0) z USING (label) GROUP BY label")
