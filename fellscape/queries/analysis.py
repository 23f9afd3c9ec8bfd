"""Queries of clustering, embedding and whole studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellscape.functions.columns import col, tidy
from fellscape.operators import cluster, rescale
from fellscape.plans import analyze, compute
from fellscape.plans.study import Study
from fellscape.queries import landscape, views as v
from fellscape.queries.registry import SQL, add
from fellscape.queries.selection import COLS, STANDARD, populations
from fellscape.session import cut


def _standard(spark, sf):
    from dataclasses import replace

    s = populations(spark, sf)
    return replace(s, problem=cut(s.problem), bbob=cut(s.bbob), rgf=cut(s.rgf))


def _numbered(spark, sf):
    """Benchmark and problem rows with a dense number."""
    from pyspark.sql import Window as W

    s = _standard(spark, sf)
    rows = s.bbob.select("label", *[col(c) for c in s.features]).unionByName(s.problem.select("label", *[col(c) for c in s.features]))
    return rows.withColumn("leaf", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("label")) - 1), s.features


def _linkage(spark, sf):
    rows, features = _numbered(spark, sf)
    return cluster.ward_linkage(cut(rows), features, "leaf").withColumn("height", tidy("height"))


def _clusters(spark, sf):
    threshold, _, flat = analyze.cluster_analysis(_standard(spark, sf))
    return flat.select("label", "kind", "cluster", tidy(F.lit(threshold)).alias("threshold"))


def _cut_fixed(spark, sf):
    rows, features = _numbered(spark, sf)
    rows = cut(rows)
    return cluster.cut_clusters(rows.select("label", "leaf"), cluster.ward_rounds(rows, features, "leaf"), 2.0, "leaf")


# One merge at a time: the state is the list of clusters, and the nearest two are replaced by their union.
_TREE = f"""WITH RECURSIVE {STANDARD},
both_kinds AS (SELECT label, feature, z FROM std WHERE kind IN ('bbob', 'problem')),
whole AS (SELECT feature FROM both_kinds GROUP BY feature HAVING count(z) = count(*)),
leaves AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS leaf, list(z ORDER BY feature) AS c FROM both_kinds JOIN whole USING (feature) GROUP BY label),
tree AS (
  SELECT -1::BIGINT AS step, list({{'id': leaf::BIGINT, 'n': 1::BIGINT, 'c': c, 'leaves': [leaf::BIGINT]}} ORDER BY leaf) AS clusters, count(*)::BIGINT AS m,
         NULL::BIGINT AS left_id, NULL::BIGINT AS right_id, NULL::DOUBLE AS height, NULL::BIGINT AS size FROM leaves
  UNION ALL
  SELECT step + 1, list_append(list_filter(clusters, lambda e: e.id <> best.a.id AND e.id <> best.b.id),
           {{'id': m + step + 1, 'n': best.a.n + best.b.n, 'c': list_transform(list_zip(best.a.c, best.b.c), lambda p: (p[1] * best.a.n + p[2] * best.b.n) / (best.a.n + best.b.n)),
             'leaves': list_concat(best.a.leaves, best.b.leaves)}}), m, best.a.id, best.b.id, best.h, best.a.n + best.b.n
  FROM (SELECT step, any_value(clusters) AS clusters, any_value(m) AS m, arg_min({{'a': a, 'b': b, 'h': h}}, h) AS best
        FROM (SELECT step, clusters, m, a, b, sqrt(2.0::DOUBLE * a.n * b.n / (a.n + b.n)) * list_distance(a.c, b.c) AS h
              FROM (SELECT step, clusters, m, a, unnest(clusters) AS b FROM (SELECT step, clusters, m, unnest(clusters) AS a FROM tree))
              WHERE a.id < b.id) GROUP BY step))"""


def _flat_sql(threshold):
    return f"""cut AS (SELECT clusters FROM tree WHERE step = (SELECT coalesce(max(step), -1) FROM tree WHERE height < {threshold})),
flat AS (SELECT unnest(c.leaves) AS leaf, list_min(c.leaves) AS cluster FROM (SELECT unnest(clusters) AS c FROM cut))"""


_THRESHOLD = "(SELECT avg(nullif(dist, 0)) FROM far)"
_FAR = """far AS (SELECT sqrt(sum((a.z - b.z) ** 2)) AS dist FROM std a JOIN std b USING (feature)
WHERE a.kind = 'bbob' AND b.kind = 'bbob' AND a.label < b.label GROUP BY a.label, b.label)"""
add("ward_linkage", _linkage, f"{_TREE} SELECT step, left_id, right_id, {v.t('height')} AS height, size FROM tree WHERE step >= 0")
add("cut_clusters", _cut_fixed, f"{_TREE}, {_flat_sql('2.0')} SELECT label, leaf, cluster FROM leaves JOIN flat USING (leaf)")
add("cluster_analysis", _clusters, f"""{_TREE}, {_FAR}, {_flat_sql(_THRESHOLD)}
SELECT label, kind, cluster, {v.t(_THRESHOLD)} AS threshold FROM leaves JOIN flat USING (leaf) JOIN (SELECT DISTINCT label, kind FROM std) AS k USING (label)""")
# The two leading axes by power iteration: a matrix is squared until its leading axis is left; then the same without that axis.
_MATRIX = "list_transform({0}, lambda r: list_transform({0}, lambda c: list_dot_product(r, c)))"
_SCALED = "list_transform({0}, lambda r: list_transform(r, lambda e: e / list_max(list_transform({0}, lambda q: list_max(list_transform(q, lambda f: abs(f)))))))"


def _axis_sql(name, matrix):
    """CTEs from a table ``matrix`` (c) to the unit axis ``name`` (v) whose largest loading is positive."""
    return f"""{name}_p AS (SELECT 0 AS k, {_SCALED.format('c')} AS q FROM {matrix}
  UNION ALL SELECT k + 1, {_SCALED.format('s')} FROM (SELECT k, {_MATRIX.format('q')} AS s FROM {name}_p WHERE k < 16)),
{name}_r AS (SELECT r FROM (SELECT unnest(q) AS r FROM {name}_p WHERE k = 16) ORDER BY list_dot_product(r, r) DESC LIMIT 1),
{name} AS (SELECT list_transform(r, lambda e: e / sqrt(list_dot_product(r, r)) * sign(r[list_position(list_transform(r, lambda f: abs(f)), list_max(list_transform(r, lambda f: abs(f))))])) AS v FROM {name}_r)"""


_AXES = f"""ec AS (SELECT feature, avg(z) AS m FROM std GROUP BY feature HAVING count(z) = count(*)),
ez AS (SELECT label, kind, feature, z - m AS z FROM std JOIN ec USING (feature)),
em AS (SELECT list(row ORDER BY feature) AS c FROM (SELECT fa AS feature, list(s ORDER BY fb) AS row FROM
       (SELECT a.feature AS fa, b.feature AS fb, sum(a.z * b.z) AS s FROM ez a JOIN ez b USING (label, kind) GROUP BY ALL) GROUP BY fa)),
{_axis_sql('one', 'em')},
ed AS (SELECT list_transform(list_zip(c, v), lambda p: list_transform(list_zip(p[1], v), lambda e: e[1] - l * p[2] * e[2])) AS c
       FROM (SELECT c, v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS l FROM em, one)),
{_axis_sql('two', 'ed')},
er AS (SELECT label, kind, list(z ORDER BY feature) AS x FROM ez GROUP BY label, kind)"""
add("embed_2d", lambda spark, sf: analyze.embed_populations(_standard(spark, sf)).select(
    "label", "kind", tidy("x0").alias("x0"), tidy("x1").alias("x1")),
    f"""WITH RECURSIVE {STANDARD}, {_AXES} SELECT label, kind, {v.t('list_dot_product(x, one.v)')} AS x0, {v.t('list_dot_product(x, two.v)')} AS x1
FROM er, one, two""")


def _analysis(spark, sf):
    rows = v.feature_rows(spark, sf)
    result = analyze.analyze(rows, COLS)
    return (result.clusters.select("label", "cluster").join(result.embedding.select("label", "kind", "x0", "x1"), "label", "right")
            .select("label", "kind", "cluster", tidy("x0").alias("x0"), tidy("x1").alias("x1")))


add("analyze", _analysis, f"""{_TREE}, {_FAR}, {_flat_sql(_THRESHOLD)}, {_AXES}, named AS (SELECT label, cluster FROM leaves JOIN flat USING (leaf))
SELECT er.label, kind, cluster, {v.t('list_dot_product(x, one.v)')} AS x0, {v.t('list_dot_product(x, two.v)')} AS x1
FROM er CROSS JOIN one CROSS JOIN two LEFT JOIN named ON named.label = er.label""")


def part_study(**settings):
    return Study(bounds=v.PART_BOUNDS, responses=("y1", "y2"), **settings)


def _compute(spark, sf):
    """Every family for both responses, without functions, on all rows."""
    study = part_study(bootstrap=False, fids=(), generated=0)
    return compute.compute_features_many(study, v.doe_part(spark, sf).dropna()).features.select(
        "label", "kind", "feature", tidy("value").alias("value"))


def _features_sql():
    """The features of both responses, each by its own SQL, on the grid of all of them."""
    names = [f"{family}.{name}" for family, own in compute.FEATURES.items() for name in own]
    each = " UNION ALL ".join(f"SELECT label, feature, value FROM ({SQL[name]})" for name in names)
    return f"""SELECT 'problem_' || g.label AS label, 'problem' AS kind, g.feature, r.value
FROM (SELECT label, unnest([{', '.join(f"'{n}'" for n in names)}]) AS feature FROM (VALUES ('y1'), ('y2')) AS l(label)) AS g
LEFT JOIN ({each}) AS r ON r.label = g.label AND r.feature = g.feature"""


add("compute_features", _compute, _features_sql())


def _many(spark, sf):
    """The example study: ten benchmark functions, five generated ones, two subsamples at 0.8."""
    study = part_study(fids=tuple(range(1, 11)), generated=5, seed=1)
    return compute.compute_features_many(study, v.doe_part(spark, sf).dropna())


add("compute_features_many", lambda spark, sf: _many(spark, sf).features)


def _status(spark, sf):
    """What is missing with a constant and an incomplete response beside a good one: they fail in every family."""
    points, n = landscape.frame(spark, sf)
    good, flat, holes = F.col("y1"), F.lit(3.0), F.when(F.col("sample_id") % 500 != 7, F.col("y2"))
    points = points.select("rep", "sample_id", *landscape.X, good.alias("good"), flat.alias("flat"), holes.alias("holes"))
    labels = ["good", "flat", "holes"]
    points = cut(rescale.normalize_response(points, ["rep"], labels, bound=1))
    return compute.family_status(compute.compute_features(points, landscape.X, labels, landscape.BOX, [0], n))


_STATUS_SQL = f"""WITH {v.POINTS}, l AS (SELECT unnest(['good', 'flat', 'holes']) AS label),
f AS (SELECT unnest([{', '.join(f"'{f}'" for f in compute.FEATURES)}]) AS family, unnest([{', '.join(str(len(f)) for f in compute.FEATURES.values())}]) AS n),
h AS (SELECT 'good' AS label, count(*) = count(y1) AND max(y1) > min(y1) AS whole FROM norm UNION ALL SELECT 'flat', false
      UNION ALL SELECT 'holes', count(*) = count(CASE WHEN sample_id % 500 <> 7 THEN y2 END) FROM norm)
SELECT label, family, n::BIGINT AS n_features, CASE WHEN whole THEN 0 ELSE n END::BIGINT AS n_missing, CASE WHEN whole THEN 'ok' ELSE 'failed' END AS status
FROM l JOIN h USING (label) CROSS JOIN f"""
add("family_status", _status, _STATUS_SQL)


def _study(spark, sf):
    """From raw samples to the clusters of the example study."""
    wide, names = compute.pivot_features(_many(spark, sf).features)
    result = analyze.analyze(wide, names)
    return result.clusters.select("label", "kind", "cluster")


add("study_clusters", _study)


def _config(spark, sf):
    """Limits of the inputs taken from the parts of a brand; a study refuses those without extent."""
    limits = v.table(spark, sf, "part").groupBy("p_brand", "p_type").agg(
        F.min("p_size").alias("lower"), F.max("p_size").alias("upper"), F.count("*").alias("n"))
    study = part_study()
    labels = len(study.functions) + study.generated + len(study.responses)
    return limits.select("p_brand", "p_type", (F.col("upper") <= F.col("lower")).alias("refused"),
                         (F.col("n") * labels * len(study.reps)).alias("values"))


add("study_config", _config, "SELECT p_brand, p_type, max(p_size) <= min(p_size) AS refused, count(*) * 31 * 2 AS values FROM part GROUP BY ALL")
