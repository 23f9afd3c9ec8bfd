"""Queries of means, correlations, feature selection and standardisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellscape.functions.columns import col, single, tidy
from fellscape.operators import clean, correlate, standardize, tables, tiles
from fellscape.queries import views as v
from fellscape.queries.registry import add, query

COLS = [c for c in v.FEATURES if c not in ("pca.expl_var.cov_x", "ela_meta.costs_runtime")]
COL_LIST = ", ".join(f"'{c}'" for c in COLS)


def frame(spark, sf):
    df = clean.inf_to_null(v.feature_rows(spark, sf))
    return df.select("label", "kind", "fid", "iid", "rep", *[col(c) for c in COLS])


def _pop(spark, sf, kind):
    return frame(spark, sf).where(F.col("kind") == kind)


FRAME = f"""{v.FEATURE_ROWS}, frame AS (SELECT * REPLACE (CASE WHEN isinf(tax_open) THEN NULL ELSE tax_open END AS tax_open) FROM feat)"""


def means_sql(key, where):
    return f"SELECT {key}, " + ", ".join(f'avg("{c}") AS "{c}"' for c in COLS) + f" FROM frame WHERE {where} GROUP BY {key}"


add("mean_by_fid", lambda spark, sf: standardize.mean_by_fid(_pop(spark, sf, "bbob"), COLS)
    .select("fid", *[single(c).alias(c) for c in COLS]),
    f"WITH {FRAME}, m AS ({means_sql('fid', 'fid IS NOT NULL')}) SELECT fid, {v.s(COLS)} FROM m")
add("mean_by_label", lambda spark, sf: standardize.mean_by_label(frame(spark, sf), COLS)
    .select("label", *[single(c).alias(c) for c in COLS]),
    f"WITH {FRAME}, m AS ({means_sql('label', 'true')}) SELECT label, {v.s(COLS)} FROM m")

# Long cells with the column order, the input of every correlation in SQL.
CELLS = f"""{FRAME}, cells AS (SELECT label AS id, rep, feature, value, list_position([{COL_LIST}], feature) - 1 AS ord
FROM frame UNPIVOT (value FOR feature IN ({', '.join(f'"{c}"' for c in COLS)}))),
pairs AS (SELECT a.ord AS i, b.ord AS j, a.value AS va, b.value AS vb, a.id, a.rep FROM cells a JOIN cells b
  ON a.id = b.id AND a.rep = b.rep AND a.ord < b.ord),
grid AS (SELECT i.i AS i, j.j AS j FROM (SELECT unnest(range({len(COLS)})) AS i) i, (SELECT unnest(range({len(COLS)})) AS j) j WHERE i.i < j.j)"""
R_SQL = "covar_pop(va, vb) / nullif(stddev_pop(va) * stddev_pop(vb), 0)"


def corr_sql(inner):
    return f"""WITH {CELLS}, c AS ({inner})
SELECT grid.i::INTEGER AS ord_a, grid.j::INTEGER AS ord_b, ([{COL_LIST}])[grid.i + 1] AS feat_a, ([{COL_LIST}])[grid.j + 1] AS feat_b, {v.t('r')} AS r
FROM grid LEFT JOIN c ON c.i = grid.i AND c.j = grid.j"""


def _corr(method):
    def run(spark, sf):
        pairs = correlate.corr_matrix(frame(spark, sf), COLS, method).withColumn("r", tidy("r"))
        # Pairs without any complete row are listed too, as missing.
        names = F.array(*[F.lit(c) for c in COLS])
        n = len(COLS)
        whole = (v.table(spark, sf, "part").agg(F.count("*")).select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("ord_a"), F.lit(j).alias("ord_b")) for i in range(n) for j in range(i + 1, n)])).alias("p"))
            .select("p.*", F.get(names, F.col("p.ord_a")).alias("feat_a"), F.get(names, F.col("p.ord_b")).alias("feat_b")))
        return whole.join(pairs.select("ord_a", "ord_b", "r"), ["ord_a", "ord_b"], "left")
    return run


add("corr_matrix", _corr("pearson"), corr_sql(f"SELECT i, j, {R_SQL} AS r FROM pairs GROUP BY i, j"))
add("corr_matrix_spearman", _corr("spearman"), corr_sql(
    """SELECT i, j, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS r FROM (SELECT i, j,
rank() OVER (PARTITION BY i, j ORDER BY va) + (count(*) OVER (PARTITION BY i, j, va) - 1) / 2.0::DOUBLE AS ra,
rank() OVER (PARTITION BY i, j ORDER BY vb) + (count(*) OVER (PARTITION BY i, j, vb) - 1) / 2.0::DOUBLE AS rb FROM pairs) GROUP BY i, j"""))
add("corr_matrix_kendall", _corr("kendall"), corr_sql(
    """SELECT i, j, sum(sign(p.va - q.va) * sign(p.vb - q.vb)) / nullif(sqrt(count(CASE WHEN p.va <> q.va THEN 1 END)::DOUBLE)
* sqrt(count(CASE WHEN p.vb <> q.vb THEN 1 END)::DOUBLE), 0) AS r
FROM pairs p JOIN pairs q USING (i, j) WHERE (p.id, p.rep) < (q.id, q.rep) GROUP BY i, j"""))


@query("upper_triangle", corr_sql(f"SELECT i, j, {R_SQL} AS r FROM pairs GROUP BY i, j"))
def upper_triangle(spark, sf):
    half = _corr("pearson")(spark, sf)
    flip = half.select(F.col("ord_b").alias("ord_a"), F.col("ord_a").alias("ord_b"),
                       F.col("feat_b").alias("feat_a"), F.col("feat_a").alias("feat_b"), "r")
    return correlate.upper_triangle(half.unionByName(flip))


CORR = f"""{CELLS}, corr AS (SELECT ([{COL_LIST}])[i + 1] AS fa, ([{COL_LIST}])[j + 1] AS fb, {R_SQL} AS r FROM pairs GROUP BY i, j),
both_ways AS (SELECT fa AS f, abs(r) AS r FROM corr UNION ALL SELECT fb, abs(r) FROM corr),
sums AS (SELECT f, sum(r) AS s, count(r) AS n FROM both_ways GROUP BY f),
rep AS (SELECT fb AS feat_a, fa AS feat_b, (a.s - abs(r)) / nullif(a.n - 1, 0) AS corr_a_mean,
  (b.s - abs(r)) / nullif(b.n - 1, 0) AS corr_b_mean, r AS corr_pair
  FROM corr JOIN sums a ON a.f = fb JOIN sums b ON b.f = fa WHERE abs(r) >= 0.9),
drops AS (SELECT DISTINCT CASE WHEN corr_a_mean > corr_b_mean + 1e-9 THEN feat_a ELSE feat_b END AS feature FROM rep)"""


def _matrix(spark, sf):
    return correlate.corr_matrix(frame(spark, sf), COLS)


add("corr_pairs", lambda spark, sf: correlate.corr_pairs(_matrix(spark, sf), 0.9).withColumn("corr_pair", tidy("corr_pair")),
    f"WITH {CORR} SELECT feat_a, feat_b, {v.t('corr_pair')} AS corr_pair FROM rep")
_REPORT = ["corr_a_mean", "corr_b_mean", "corr_pair"]
add("corr_pair_report", lambda spark, sf: correlate.corr_pair_report(_matrix(spark, sf), 0.9)
    .select("feat_a", "feat_b", *[tidy(c).alias(c) for c in _REPORT]),
    f"WITH {CORR} SELECT feat_a, feat_b, {v.r(_REPORT)} FROM rep")
add("drop_correlated_pair", lambda spark, sf: correlate.drop_list(correlate.corr_pair_report(_matrix(spark, sf), 0.9)),
    f"WITH {CORR} SELECT feature FROM drops")
add("protect_features", lambda spark, sf: correlate.protect_features(
    correlate.drop_list(correlate.corr_pair_report(_matrix(spark, sf), 0.9)), ["tax", "sd"]),
    f"WITH {CORR} SELECT feature FROM drops WHERE NOT contains(feature, 'tax') AND NOT contains(feature, 'sd')")
add("drop_correlated_direct", lambda spark, sf: correlate.direct_drop_list(_matrix(spark, sf), 0.9),
    f"WITH {CORR} SELECT DISTINCT fb AS feature FROM corr WHERE r > 0.9")


@query("drop_correlated_table", f"""WITH {CORR} SELECT id AS label, rep, feature, {v.f('value')} AS value FROM cells
WHERE feature NOT IN (SELECT feature FROM drops)""")
def drop_correlated_table(spark, sf):
    kept, _ = correlate.drop_correlated(frame(spark, sf), COLS, 0.9)
    names = [c for c in kept.columns if c in COLS]
    return (tables.to_long(kept.select("label", "rep", *[col(c) for c in names]), names, "feature", "value")
            .where("value IS NOT NULL").withColumn("value", single("value")))


_NUM = [c for c in COLS if c not in ("nothing", "q_var", "disc_gap")]
add("zscore_fit", lambda spark, sf: standardize.zscore_fit(_pop(spark, sf, "bbob"), _NUM)
    .select("feature", single("mean").alias("mean"), single("sd").alias("sd")),
    f"""WITH {FRAME}, c AS (SELECT feature, value FROM frame UNPIVOT (value FOR feature IN ({', '.join(_NUM)})) WHERE kind = 'bbob')
SELECT feature, {v.f('avg(value)')} AS mean, {v.f('CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END')} AS sd FROM c GROUP BY feature""")


@query("zscore_transform", f"""WITH {FRAME}, c AS (SELECT label, kind, rep, feature, value FROM frame UNPIVOT (value FOR feature IN ({', '.join(_NUM)}))),
p AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM c WHERE kind = 'bbob' GROUP BY feature)
SELECT label, rep, feature, {v.t('(value - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END')} AS z FROM c JOIN p USING (feature) WHERE kind <> 'bbob'""")
def zscore_transform(spark, sf):
    params = standardize.zscore_fit(_pop(spark, sf, "bbob"), _NUM)
    rest = frame(spark, sf).where("kind <> 'bbob'").select("label", "rep", *[col(c) for c in _NUM])
    z = standardize.zscore_transform(rest, params)
    return tables.to_long(z, _NUM, "feature", "z").where("z IS NOT NULL").withColumn("z", tidy("z"))


def populations(spark, sf):
    return standardize.standardize_populations(
        _pop(spark, sf, "problem"), _pop(spark, sf, "bbob"), _pop(spark, sf, "rgf"), COLS)


# The whole recipe in SQL, long layout: benchmark means, kept columns, correlation, scale.
STANDARD = f"""{FRAME}, long AS (SELECT label, kind, fid, feature, value FROM frame UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(COLS)}))),
bm AS (SELECT fid, feature, avg(value) AS value FROM long WHERE kind = 'bbob' GROUP BY fid, feature),
good AS (SELECT feature, list_position([{COL_LIST}], feature) AS ord FROM bm GROUP BY feature
  HAVING count(value) = count(*) AND min(value) < max(value)),
bp AS (SELECT a.feature AS fa, b.feature AS fb, covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) AS r
  FROM bm a JOIN good ga ON ga.feature = a.feature JOIN bm b ON b.fid = a.fid JOIN good gb ON gb.feature = b.feature
  WHERE ga.ord < gb.ord GROUP BY ALL),
bw AS (SELECT fa AS f, abs(r) AS r FROM bp UNION ALL SELECT fb, abs(r) FROM bp),
bs AS (SELECT f, sum(r) AS s, count(r) AS n FROM bw GROUP BY f),
bd AS (SELECT DISTINCT CASE WHEN (a.s - abs(r)) / nullif(a.n - 1, 0) > (b.s - abs(r)) / nullif(b.n - 1, 0) + 1e-9 THEN fb ELSE fa END AS feature
  FROM bp JOIN bs a ON a.f = fb JOIN bs b ON b.f = fa WHERE abs(r) >= 0.95),
keep AS (SELECT feature FROM good WHERE feature NOT IN (SELECT feature FROM bd)),
par AS (SELECT feature, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd
  FROM bm JOIN keep USING (feature) GROUP BY feature),
lm AS (SELECT label, kind, feature, avg(value) AS value FROM long JOIN keep USING (feature) WHERE kind <> 'bbob' GROUP BY ALL),
std AS (SELECT concat('f', fid) AS label, 'bbob' AS kind, feature, (value - m) / sd AS z FROM bm JOIN par USING (feature)
  UNION ALL SELECT label, kind, feature, (value - m) / sd FROM lm JOIN par USING (feature)
  WHERE kind = 'problem' OR label NOT IN (SELECT label FROM lm WHERE kind = 'rgf' AND value IS NULL))"""


@query("standardize_populations", f"WITH {STANDARD} SELECT label, kind, feature, {v.t('z')} AS z FROM std")
def standardize_all(spark, sf):
    s = populations(spark, sf)
    parts = [tables.to_long(getattr(s, kind), s.features, "feature", "z").withColumn("kind", F.lit(kind))
             for kind in ("problem", "bbob", "rgf")]
    return tables.union_populations(parts).select("label", "kind", "feature", tidy("z").alias("z"))


_DIST = """SELECT a.label AS id_a, b.label AS id_b, sqrt(sum((a.z - b.z) ** 2)) AS dist FROM std a JOIN std b USING (feature)
WHERE a.kind = 'bbob' AND b.kind = 'bbob' AND a.label < b.label GROUP BY ALL"""


@query("pairwise_distance", f"WITH {STANDARD}, d AS ({_DIST}) SELECT id_a, id_b, {v.t('dist')} AS dist FROM d")
def pairwise_distance(spark, sf):
    s = populations(spark, sf)
    return tiles.pairwise_distance(s.bbob, "label", s.features).withColumn("dist", tidy("dist"))


@query("mean_intercluster_distance", f"WITH {STANDARD}, d AS ({_DIST}) SELECT {v.t('avg(nullif(dist, 0))')} AS mean_dist, count(nullif(dist, 0)) AS n_pairs FROM d")
def mean_intercluster_distance(spark, sf):
    s = populations(spark, sf)
    return tiles.mean_distance(s.bbob, "label", s.features).withColumn("mean_dist", tidy("mean_dist"))


@query("nearest_benchmark", f"""WITH {STANDARD}, d AS (SELECT p.label, b.label AS benchmark, sqrt(sum((p.z - b.z) ** 2)) AS dist
FROM std p JOIN std b USING (feature) WHERE p.kind = 'problem' AND b.kind = 'bbob' GROUP BY ALL)
SELECT label, benchmark, {v.t('dist')} AS dist, row_number() OVER (PARTITION BY label ORDER BY d.dist, benchmark)::INTEGER AS rank FROM d
QUALIFY row_number() OVER (PARTITION BY label ORDER BY d.dist, benchmark) <= 3""")
def nearest_benchmark(spark, sf):
    s = populations(spark, sf)
    return standardize.nearest_benchmark(s.problem, s.bbob, s.features, 3).withColumn("dist", tidy("dist"))



@query("merge_populations", f"WITH {v.FEATURE_ROWS} SELECT label, kind, {v.s([c for c in COLS if c != 'tax_open'] + ['ela_meta.costs_runtime'])}, "
       "CASE WHEN isinf(tax_open) THEN NULL ELSE CAST(CAST(tax_open AS FLOAT) AS DOUBLE) END AS tax_open FROM feat")
def merge_populations(spark, sf):
    from fellscape.plans.analyze import merge_populations as merge

    rows = v.feature_rows(spark, sf).drop("fid", "iid", "rep")
    kinds = [rows.where(F.col("kind") == k) for k in ("problem", "bbob", "rgf")]
    merged = tables.union_populations(list(merge(*kinds)))
    return merged.select("label", "kind", *[single(c).alias(c) for c in merged.columns if c not in ("label", "kind")])
