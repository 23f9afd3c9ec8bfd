"""Queries of sources, cleaning, joins, unions and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellscape.functions.columns import col, single, tidy
from fellscape.operators import clean, rescale, tables
from fellscape.operators.rescale import Bounds
from fellscape.queries import views as v
from fellscape.queries.registry import add, query
from fellscape.session import run_path
from fellscape.sources import doe, store

XY = ["x1", "x2", "y1", "y2"]


def _tidy(df, cols, keep=("sample_id",), digits=6):
    return df.select(*[col(c) for c in keep], *[tidy(c, digits).alias(c) for c in cols])


# ---- sources -------------------------------------------------------------------------------

def part_spec(spark):
    """Column list and limits of the parts study, as the small tables a user would supply."""
    spec = spark.createDataFrame([
        ("input", "size", "x1", 1), ("input", "price", "x2", 2),
        ("output", "revenue", "y1", 3), ("output", "sold", "y2", 4)], doe.COLSPEC)
    bounds = spark.createDataFrame([("x1", 1, 1.0, 50.0), ("x2", 2, 900.0, 1000.0)], doe.BOUNDS)
    return spec, bounds


def part_table(spark, sf):
    """The parts samples under their original names, revenue as text with the sentinel for small parts."""
    base = v.doe_part(spark, sf)
    return base.select(
        "sample_id", F.col("x1").alias("size"), F.col("x2").alias("price"),
        F.when(F.col("x1") <= 2, "EXPRESSION_ERROR").otherwise(F.col("y1").cast("string")).alias("revenue"),
        F.col("y2").alias("sold"), F.lit("ignored").alias("comment"))


@query("load_doe", f"""WITH {v.DOE_PART}
SELECT sample_id, {v.r(XY)} FROM (SELECT * FROM doe WHERE x1 > 2 AND y1 IS NOT NULL AND y2 IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY x1, x2 ORDER BY sample_id) = 1)""")
def load_doe(spark, sf):
    spec, _ = part_spec(spark)
    loaded = doe.load_doe(part_table(spark, sf), doe.load_colspec(spec), "sample_id")
    return _tidy(loaded, XY)


@query("load_bounds", """SELECT dv, ord, lower + 0.0 AS lower, upper FROM (SELECT 'l_quantity' AS dv, 1 AS ord, min(l_quantity) AS lower, max(l_quantity) AS upper FROM lineitem
UNION ALL SELECT 'l_discount', 2, min(l_discount), max(l_discount) FROM lineitem
UNION ALL SELECT 'l_tax', 3, min(l_tax), max(l_tax) FROM lineitem)""")
def load_bounds(spark, sf):
    """Limits measured on the line items, read back in input order."""
    names = ["l_quantity", "l_discount", "l_tax"]
    row = v.table(spark, sf, "lineitem").agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("lo", F.min), ("hi", F.max))])
    rows = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("dv"), F.lit(i + 1).alias("ord"), col(f"{c}_lo").alias("lower"), col(f"{c}_hi").alias("upper"))
        for i, c in enumerate(names)])).alias("b")).select("b.*")
    limits = doe.load_bounds(rows)
    return spark.createDataFrame(
        [(n, i + 1, lo, hi) for i, (n, lo, hi) in enumerate(zip(limits.names, limits.lower, limits.upper))], doe.BOUNDS)


def long_features(spark, sf):
    return (tables.to_long(v.feature_rows(spark, sf), v.FEATURES, "feature", "value")
            .where(F.col("value").isNotNull()))


LONG_SQL = f"""{v.FEATURE_ROWS}, long AS (SELECT label, kind, fid, iid, rep, feature, value FROM feat
  UNPIVOT (value FOR feature IN ({", ".join(f'"{c}"' for c in v.FEATURES)})))"""
REQUEST = ["problem_21", "bbob_f1_ins1", "bbob_f7_ins3", "rgf1"]
REQUEST_SQL = "label IN ('problem_21', 'bbob_f1_ins1', 'bbob_f7_ins3', 'rgf1')"
LONG_OUT = f"label, kind, rep, feature, {v.f('value')} AS value"


def _long_out(df):
    return df.select("label", "kind", "rep", "feature", single("value").alias("value"))


def stored_features(spark, sf):
    path = run_path(spark, "features")
    store.write_features(long_features(spark, sf), path)
    return path


add("write_features", lambda spark, sf: _long_out(store.read_features(spark, stored_features(spark, sf))),
    f"WITH {LONG_SQL} SELECT {LONG_OUT} FROM long")
add("read_features", lambda spark, sf: _long_out(store.read_features(spark, stored_features(spark, sf), REQUEST)),
    f"WITH {LONG_SQL} SELECT {LONG_OUT} FROM long WHERE {REQUEST_SQL}")


def _asked(spark, sf):
    """Labels asked for: every brand, with its first type, as a problem, a benchmark or a generated function."""
    n = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    k = F.array_position(F.array(*[F.lit(t) for t in v.TYPES]), F.col("p_type"))
    return (v.table(spark, sf, "part").groupBy(n.alias("n")).agg(F.min(k).alias("k"))
            .select(F.when(F.col("n") <= 20, tables.benchmark_label("n", "k"))
                    .when(F.col("n") <= 22, tables.problem_label(F.col("n").cast("string")))
                    .otherwise(tables.generated_label(F.col("n") - 20)).alias("label")).distinct())


ASKED_SQL = """asked AS (SELECT DISTINCT CASE WHEN n <= 20 THEN concat('bbob_f', n, '_ins', k)
  WHEN n <= 22 THEN concat('problem_', n) ELSE concat('rgf', n - 20) END AS label
  FROM (SELECT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS n,
    min(list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type)) AS k FROM part GROUP BY 1))"""


@query("read_features_tolerant", f"""WITH {LONG_SQL}, {ASKED_SQL}
SELECT {LONG_OUT} FROM long WHERE label IN (SELECT label FROM asked)""")
def read_features_tolerant(spark, sf):
    stored = store.read_features(spark, stored_features(spark, sf))
    return _long_out(store.read_features_tolerant(stored, _asked(spark, sf)))


@query("requested_status", f"""WITH {LONG_SQL}, {ASKED_SQL}
SELECT label, 'rgf' AS kind, 'skipped' AS status FROM asked WHERE label NOT IN (SELECT label FROM long)""")
def requested_status(spark, sf):
    return store.requested_status(_asked(spark, sf), long_features(spark, sf))


@query("parse_literal_list", """SELECT event_id, 0 AS pos, value AS y FROM events
UNION ALL SELECT event_id, 1, CASE WHEN event_type = 'error' THEN NULL ELSE -value END FROM events
UNION ALL SELECT event_id, 2, CASE WHEN event_type = 'view' THEN NULL ELSE 2 * value END FROM events""")
def parse_literal_list(spark, sf):
    """Event values written as list text, with ``nan`` and ``inf`` cells, and parsed again."""
    text = F.concat(F.lit("["), F.col("value").cast("string"), F.lit(", "),
                    F.when(F.col("event_type") == "error", "nan").otherwise((-F.col("value")).cast("string")), F.lit(", "),
                    F.when(F.col("event_type") == "view", "inf").otherwise((2 * F.col("value")).cast("string")), F.lit("]"))
    lists = v.table(spark, sf, "events").select("event_id", doe.parse_literal_list(text).alias("ys"))
    cells = lists.select("event_id", F.posexplode("ys").alias("pos", "y"))
    return clean.inf_to_null(cells, ["y"])


# ---- projections, filters, cleaning -------------------------------------------------------------

@query("select_by_spec", "SELECT l_quantity, l_discount, l_extendedprice FROM lineitem")
def select_by_spec(spark, sf):
    spec = doe.ColumnSpec((("l_quantity", "q"), ("l_discount", "d")), (("l_extendedprice", "p"),))
    return doe.select_by_spec(v.table(spark, sf, "lineitem"), spec)


@query("rename_by_spec", "SELECT l_quantity AS q, l_discount AS d, l_extendedprice AS p FROM lineitem")
def rename_by_spec(spark, sf):
    spec = doe.ColumnSpec((("l_quantity", "q"), ("l_discount", "d")), (("l_extendedprice", "p"),))
    return doe.rename_by_spec(doe.select_by_spec(v.table(spark, sf, "lineitem"), spec), spec)


add("sentinel_to_null", lambda spark, sf: clean.sentinel_to_null(v.sentinel(spark, sf), ["price"]),
    f"WITH {v.SENTINEL} SELECT o_orderkey, o_custkey, TRY_CAST(nullif(price, 'EXPRESSION_ERROR') AS DOUBLE) AS price FROM raw")
add("count_rejects", lambda spark, sf: clean.count_rejects(
    v.table(spark, sf, "orders").select("o_orderstatus", F.col("o_totalprice").cast("string").alias("price")),
    ["o_orderstatus", "price"]),
    "SELECT 'o_orderstatus' AS column_name, count(*) AS rejects FROM orders UNION ALL SELECT 'price', 0")
add("drop_rows_any_null", lambda spark, sf: clean.drop_rows_any_null(
    clean.sentinel_to_null(v.sentinel(spark, sf), ["price"]), ["o_custkey", "price"]),
    f"WITH {v.SENTINEL} SELECT o_orderkey, o_custkey, CAST(price AS DOUBLE) AS price FROM raw WHERE price <> 'EXPRESSION_ERROR'")
LINE_X = ["x1", "x2", "x3"]
add("dedup_keep_first", lambda spark, sf: _tidy(
    clean.dedup_keep_first(v.doe_lineitem(spark, sf), LINE_X, "sample_id"), [*LINE_X, "y1", "y2"]),
    f"""WITH {v.DOE_LINEITEM} SELECT sample_id, {v.r([*LINE_X, "y1", "y2"])} FROM line
QUALIFY row_number() OVER (PARTITION BY x1, x2, x3 ORDER BY sample_id) = 1""")
add("dup_report", lambda spark, sf: clean.dup_report(v.doe_lineitem(spark, sf), LINE_X),
    f"WITH {v.DOE_LINEITEM}, g AS (SELECT DISTINCT x1, x2, x3 FROM line) "
    "SELECT (SELECT count(*) FROM line) - (SELECT count(*) FROM g) AS dropped, (SELECT count(*) FROM g) AS kept")
add("rescale_affine", lambda spark, sf: _tidy(
    rescale.rescale_affine(v.doe_lineitem(spark, sf), v.LINE_BOUNDS, Bounds.cube(LINE_X)), LINE_X),
    f"""WITH {v.DOE_LINEITEM} SELECT sample_id, {v.t('(x1 - 1) / 49 * 10 - 5')} AS x1,
{v.t('x2 / 0.1::DOUBLE * 10 - 5')} AS x2, {v.t('x3 / 0.08::DOUBLE * 10 - 5')} AS x3 FROM line""")
add("validate_doe", lambda spark, sf: rescale.validate_doe(
    v.doe_lineitem(spark, sf), v.LINE_BOUNDS, ["y1", "y2"], Bounds.cube(LINE_X)),
    "SELECT 3 AS n_inputs, 2 AS n_responses, count(*) AS n_rows FROM lineitem")
add("normalize_response", lambda spark, sf: rescale.normalize_response(
    v.table(spark, sf, "events").select(F.col("event_type").alias("label"), F.col("event_id").alias("sample_id"),
                                        F.col("value").alias("y")), ["label"], ["y"])
    .select("label", "sample_id", tidy("y").alias("y")),
    f"""SELECT label, sample_id, {v.t("(value - lo) / nullif(hi - lo, 0)")} AS y FROM
(SELECT event_type AS label, event_id AS sample_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi
 FROM events WINDOW w AS (PARTITION BY event_type))""")
add("preprocess", lambda spark, sf: _tidy(
    rescale.preprocess(v.doe_lineitem(spark, sf), v.LINE_BOUNDS, "sample_id", Bounds.cube(LINE_X)), [*LINE_X, "y1", "y2"]),
    f"""WITH {v.DOE_LINEITEM} SELECT sample_id, {v.t('(x1 - 1) / 49 * 10 - 5')} AS x1,
{v.t('x2 / 0.1::DOUBLE * 10 - 5')} AS x2, {v.t('x3 / 0.08::DOUBLE * 10 - 5')} AS x3, {v.r(["y1", "y2"])} FROM line
QUALIFY row_number() OVER (PARTITION BY line.x1, line.x2, line.x3 ORDER BY sample_id) = 1""")

# Wide feature table: the same seven-digit rounding on both sides.
KEYS = ["label", "kind", "rep"]


def wide(df):
    names = [c for c in df.columns if c in v.FEATURES]
    return df.select(*[c for c in KEYS if c in df.columns], *[single(c).alias(c) for c in names])


def wide_sql(names, where="", keys=KEYS):
    return f"WITH {v.FEATURE_ROWS} SELECT {', '.join(keys)}, {v.s(names)} FROM feat {where}"


def features_wide(spark, sf):
    return v.feature_rows(spark, sf).select("label", "kind", "rep", *[col(c) for c in v.FEATURES])


def _values(spark, sf):
    return features_wide(spark, sf).select(*[col(c) for c in v.FEATURES])


NO_OPEN = [c for c in v.FEATURES if c != "tax_open"]
add("inf_to_null", lambda spark, sf: wide(clean.inf_to_null(features_wide(spark, sf))),
    f"WITH {v.FEATURE_ROWS} SELECT label, kind, rep, {v.s(NO_OPEN)}, "
    "CASE WHEN isinf(tax_open) THEN NULL ELSE CAST(CAST(tax_open AS FLOAT) AS DOUBLE) END AS tax_open FROM feat")
add("fill_null", lambda spark, sf: wide(clean.fill_null(features_wide(spark, sf), 0.0)),
    f"WITH {v.FEATURE_ROWS} SELECT label, kind, rep, "
    + ", ".join(f'CAST(CAST(coalesce("{c}", 0.0) AS FLOAT) AS DOUBLE) + 0.0 AS "{c}"' for c in v.FEATURES) + " FROM feat")
_BY_REGEX = [c for c in v.FEATURES if not c.startswith("pca.expl") and not c.endswith("costs_runtime")]
PATTERNS = ["pca.expl_var", ".costs_runtime"]
add("drop_cols_by_regex", lambda spark, sf: wide(clean.drop_cols_by_regex(features_wide(spark, sf), PATTERNS)), wide_sql(_BY_REGEX))
add("drop_features_by_regex", lambda spark, sf: _long_out(clean.drop_features_by_regex(long_features(spark, sf), PATTERNS)),
    f"WITH {LONG_SQL} SELECT {LONG_OUT} FROM long WHERE NOT regexp_matches(feature, 'pca.expl_var') AND NOT regexp_matches(feature, '.costs_runtime')")
add("drop_cols_all_null", lambda spark, sf: wide(clean.drop_cols_all_null(features_wide(spark, sf))),
    wide_sql([c for c in v.FEATURES if c != "nothing"]))
add("drop_cols_any_null", lambda spark, sf: wide(clean.drop_cols_any_null(features_wide(spark, sf))),
    wide_sql([c for c in v.FEATURES if c not in ("nothing", "q_var", "disc_gap")]))
_ROWS = [c for c in v.FEATURES if c != "nothing"]
add("drop_rows_incomplete", lambda spark, sf: wide(clean.drop_rows_any_null(clean.drop_cols_by_name(features_wide(spark, sf), ["nothing"]))),
    wide_sql(_ROWS, "WHERE q_var IS NOT NULL AND disc_gap IS NOT NULL"))
add("drop_cols_constant", lambda spark, sf: wide(clean.drop_cols_constant(features_wide(spark, sf))),
    wide_sql([c for c in v.FEATURES if c != "always"]))
add("drop_duplicate_rows", lambda spark, sf: clean.drop_duplicate_rows(
    v.doe_lineitem(spark, sf).select(*LINE_X)), f"WITH {v.DOE_LINEITEM} SELECT DISTINCT x1, x2, x3 FROM line")
add("reindex", lambda spark, sf: clean.reindex(
    v.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey"),
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")


def _cleaned(spark, sf):
    return clean.clean_table(
        features_wide(spark, sf), inf_as_null=True, filter_keys=PATTERNS, cols_all_null=True, cols_any_null=True,
        cols_constant=True, duplicate_rows=True, id_columns=KEYS)


_CLEAN = [c for c in _BY_REGEX if c not in ("nothing", "q_var", "disc_gap", "tax_open", "always")]
add("clean_table", lambda spark, sf: wide(_cleaned(spark, sf)[0]), wide_sql(_CLEAN))
add("clean_report", lambda spark, sf: _cleaned(spark, sf)[1],
    f"""WITH {v.FEATURE_ROWS}, c AS (SELECT count(*) AS n, count(q_var) AS qv, count(disc_gap) AS dg, count(nothing) AS nt,
count(CASE WHEN NOT isinf(tax_open) THEN 1 END) AS tx, count(DISTINCT always) AS al FROM feat)
SELECT 'filter' AS step, 'pca.expl_var.cov_x' AS feature UNION ALL SELECT 'filter', 'ela_meta.costs_runtime'
UNION ALL SELECT 'all_null', 'nothing' FROM c WHERE nt = 0 UNION ALL SELECT 'any_null', 'q_var' FROM c WHERE qv < n
UNION ALL SELECT 'any_null', 'disc_gap' FROM c WHERE dg < n UNION ALL SELECT 'any_null', 'tax_open' FROM c WHERE tx < n
UNION ALL SELECT 'constant', 'always' FROM c WHERE al = 1""")
add("drop_cols_by_name", lambda spark, sf: wide(clean.drop_cols_by_name(features_wide(spark, sf), ["rep", "kind"])),
    wide_sql(v.FEATURES, keys=["label"]))
add("split_population", lambda spark, sf: wide(tables.split_population(features_wide(spark, sf), "bbob")),
    wide_sql(v.FEATURES, "WHERE kind = 'bbob'"))

# ---- joins and unions ---------------------------------------------------------------------------------

add("align_xy", lambda spark, sf: _tidy(tables.align_xy(
    v.doe_part(spark, sf).select("sample_id", "x1", "x2"), v.doe_part(spark, sf).select("sample_id", "y1", "y2")), XY),
    f"WITH {v.DOE_PART} SELECT sample_id, {v.r(XY)} FROM doe")


@query("function_grid", "SELECT fid, iid FROM (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS fid FROM part) "
       "CROSS JOIN (SELECT unnest([1, 2, 3])::INTEGER AS iid) WHERE fid <= 24")
def function_grid(spark, sf):
    fids = (v.table(spark, sf, "part").select(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("fid"))
            .distinct().where("fid <= 24"))
    return tables.function_grid(fids, [1, 2, 3])


@query("select_shared_features", f"""WITH {LONG_SQL} SELECT {LONG_OUT} FROM long WHERE kind <> 'bbob'
AND feature IN (SELECT feature FROM long WHERE kind = 'bbob' GROUP BY feature HAVING min(value) < max(value))""")
def select_shared_features(spark, sf):
    from fellscape.operators.standardize import select_shared_features as shared

    rows = long_features(spark, sf)
    kept = (rows.where("kind = 'bbob'").groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
            .where("lo < hi").select("feature"))
    return _long_out(shared(rows.where("kind <> 'bbob'"), kept))


@query("union_populations", f"""WITH {v.FEATURE_ROWS} SELECT label, {v.s(["q_mean", "price_mean", "tax_mean"])} FROM (
SELECT label, q_mean, price_mean, NULL::DOUBLE AS tax_mean FROM feat WHERE kind = 'problem'
UNION ALL SELECT label, q_mean, NULL, tax_mean FROM feat WHERE kind = 'bbob' UNION ALL SELECT label, NULL, price_mean, tax_mean FROM feat WHERE kind = 'rgf')""")
def union_populations(spark, sf):
    w = features_wide(spark, sf)
    merged = tables.union_populations([
        w.where("kind = 'problem'").select("label", "q_mean", "price_mean"),
        w.where("kind = 'bbob'").select("label", "q_mean", "tax_mean"),
        w.where("kind = 'rgf'").select("label", "price_mean", "tax_mean")])
    return merged.select("label", *[single(c).alias(c) for c in ["q_mean", "price_mean", "tax_mean"]])


@query("merge_feature_families", f"""WITH {LONG_SQL} SELECT label, rep, feature,
{v.f("CASE WHEN feature LIKE 'disc%' THEN 2 * value ELSE value END")} AS value FROM long WHERE NOT isinf(value)""")
def merge_feature_families(spark, sf):
    rows = clean.inf_to_null(long_features(spark, sf), ["value"]).dropna(subset=["value"]).select("label", "rep", "feature", "value")
    later = rows.where("feature LIKE 'disc%'").withColumn("value", F.col("value") * 2)
    return tables.merge_feature_families([rows, later], ["label", "rep"]).withColumn("value", single("value"))


@query("dropped_columns_report", f"""WITH {LONG_SQL} SELECT DISTINCT feature FROM long
WHERE regexp_matches(feature, 'pca.expl_var') OR regexp_matches(feature, '.costs_runtime')""")
def dropped_columns_report(spark, sf):
    rows = long_features(spark, sf)
    return clean.dropped_columns_report(rows, clean.drop_features_by_regex(rows, PATTERNS))


@query("nunique_per_column", f"""WITH {v.DOE_LINEITEM} SELECT 'x1' AS feature, count(DISTINCT x1) AS n_unique FROM line
UNION ALL SELECT 'x2', count(DISTINCT x2) FROM line UNION ALL SELECT 'x3', count(DISTINCT x3) FROM line
UNION ALL SELECT 'y1', count(DISTINCT y1) FROM line""")
def nunique_per_column(spark, sf):
    return clean.nunique_per_column(v.doe_lineitem(spark, sf), [*LINE_X, "y1"])


# ---- label text -----------------------------------------------------------------------------------------

@query("split_label", f"WITH {v.FEATURE_ROWS} SELECT label, split_part(label, '_', 1) AS part_a, "
       "nullif(split_part(label, '_', 2), '') AS part_b, nullif(split_part(label, '_', 3), '') AS part_c FROM feat")
def split_label(spark, sf):
    parts = tables.split_label("label")
    return v.feature_rows(spark, sf).select("label", *[p.alias(f"part_{n}") for p, n in zip(parts, "abc")])


@query("make_label", f"WITH {v.FEATURE_ROWS} SELECT kind, fid, iid, rep, label FROM feat")
def make_label(spark, sf):
    rows = v.feature_rows(spark, sf)
    brand = F.regexp_extract("label", r"^(?:problem_|rgf)(\d+)$", 1)
    made = (F.when(F.col("kind") == "bbob", tables.benchmark_label("fid", "iid"))
            .when(F.col("kind") == "problem", tables.problem_label(brand))
            .otherwise(tables.generated_label(F.nullif(brand, F.lit("")))))
    return rows.select("kind", "fid", "iid", "rep", made.alias("label"))


add("label_contains", lambda spark, sf: tables.label_contains(v.feature_rows(spark, sf), "ins3").select("label", "rep"),
    f"WITH {v.FEATURE_ROWS} SELECT label, rep FROM feat WHERE contains(label, 'ins3')")
add("regex_column_match", lambda spark, sf: long_features(spark, sf).where(F.col("feature").rlike("expl.var"))
    .groupBy("feature").agg(F.count("*").alias("n")),
    f"WITH {LONG_SQL} SELECT feature, count(*) AS n FROM long WHERE regexp_matches(feature, 'expl.var') GROUP BY feature")
add("substring_protect", lambda spark, sf: long_features(spark, sf)
    .where(F.col("feature").contains("disc") | F.col("feature").contains("tax"))
    .groupBy("feature").agg(F.count("*").alias("n")),
    f"WITH {LONG_SQL} SELECT feature, count(*) AS n FROM long WHERE contains(feature, 'disc') OR contains(feature, 'tax') GROUP BY feature")
