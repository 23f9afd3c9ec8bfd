"""Landscape features of a study: all responses, benchmark and generated functions in shared passes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from fellscape.functions.columns import col, finite
from fellscape.operators import evaluate, rescale, sample, tables
from fellscape.operators.features import cells, dispersion, distribution, levels, linear, neighbours, walk
from fellscape.operators.rescale import Bounds
from fellscape.plans.catalogue import first_n_valid
from fellscape.plans.study import Study
from fellscape.session import cut, spread
from fellscape.sources.store import write_features

#: Every feature of a family, so that what cannot be computed is reported instead of absent.
FEATURES = {
    "ela_meta": ["lin_simple.adj_r2", "lin_simple.intercept", "lin_simple.coef.min", "lin_simple.coef.max", "lin_simple.coef.max_by_min",
                 "lin_w_interact.adj_r2", "quad_simple.adj_r2", "quad_simple.cond", "quad_w_interact.adj_r2"],
    "ela_distr": ["skewness", "kurtosis", "number_of_peaks"],
    "ela_level": [f"{name}_{p}" for p in (10, 25, 50) for name in ("mmce_lda", "mmce_qda", "lda_qda")],
    "pca": [f"{share}.{how}_{part}" for share in ("expl_var", "expl_var_PC1") for how in ("cov", "cor") for part in ("x", "init")],
    "limo": cells.LIMO,
    "nbc": ["nn_nb.sd_ratio", "nn_nb.mean_ratio", "nn_nb.cor", "dist_ratio.coeff_var", "nb_fitness.cor"],
    "disp": [f"{how}_{what}_{q:02d}" for q in (2, 5, 10, 25) for how in ("ratio", "diff") for what in ("mean", "median")],
    "ic": ["h_max", "eps_s", "eps_max", "m0", "eps_ratio"],
}


def expected(spark: SparkSession, reps: Sequence[int], labels: Sequence[str], families: Sequence[str]) -> DataFrame:
    """``(rep, label, feature)`` of a whole study: repeats x responses x features, all known beforehand."""
    names = [f"{family}.{name}" for family in FEATURES if family in families for name in FEATURES[family]]
    one = spark.range(1).select(F.explode(F.array(*[F.lit(r).cast("int") for r in reps])).alias("rep"))
    one = one.select("rep", F.explode(F.array(*[F.lit(c) for c in labels])).alias("label"))
    return one.select("rep", "label", F.explode(F.array(*[F.lit(c) for c in names])).alias("feature"))


def compute_features(points: DataFrame, x: Sequence[str], labels: Sequence[str], bounds: Bounds, reps: Sequence[int], n: int,
                     id_col: str = "sample_id", blocks: int = 2,
                     families: Sequence[str] = Study.__dataclass_fields__["families"].default) -> DataFrame:
    """``(rep, label, feature, value)`` of every family for every response of a normalised table.

    ``points`` is read several times and should be materialised; ``n`` is the largest number of
    rows of a repeat. Inputs are shared, so their sums, distances and walk are computed once per
    repeat and serve all responses. Infinite and undefined values become NULL, and so does
    every feature for which a family returns no row: the result lists all of them. A response with
    a missing value (a constant one, once normalised) has NULL features only.
    """
    bound = len(reps) * len(labels)
    linear_families = [f for f, name in (("meta", "ela_meta"), ("pca", "pca")) if name in families]
    made = []
    if linear_families:
        made.append(linear.linear_features(points, x, labels, bounds, linear_families, n))
    if "ela_distr" in families:
        made.append(distribution.distribution_features(points, labels, bound))
    if "ela_level" in families:
        made.append(levels.level_features(points, x, labels, id_col, bound=bound))
    if "limo" in families:
        made.append(cells.limo_features(points, x, labels, bounds, blocks))
    if "nbc" in families:
        made.append(neighbours.nbc_features(points, x, labels, n, id_col))
    if "disp" in families:
        made.append(dispersion.dispersion_features(points, x, labels, bounds, n, reps, id_col, bound=bound))
    if "ic" in families:
        made.append(walk.walk_features(points, x, labels, n, id_col))
    rows = tables.union_populations(made).select("rep", "label", "feature", finite("value").alias("value"))
    holes = points.groupBy("rep").agg(F.array(*[F.struct(F.lit(c).alias("label"), (F.count(F.lit(1)) == F.count(col(c))).alias("whole"))
                                                for c in labels]).alias("h"))
    whole = holes.select("rep", F.explode("h").alias("h")).select("rep", "h.label", "h.whole").where("whole").drop("whole")
    rows = rows.join(whole, ["rep", "label"])
    return expected(points.sparkSession, reps, labels, families).join(rows, ["rep", "label", "feature"], "left")


@dataclass(frozen=True)
class Computed:
    """Features of a study with the tables they came from."""

    features: DataFrame
    status: DataFrame
    catalogue: DataFrame | None
    points: DataFrame


def with_kind(features: DataFrame, problem_label: str = "problem") -> DataFrame:
    """Population and, for benchmark functions, their number and instance as columns of their own."""
    label = F.col("label")
    number = lambda pattern: F.when(F.col("kind") == "bbob", F.regexp_extract(label, pattern, 1).cast("int"))
    kind = F.when(label.startswith(f"{problem_label}_"), "problem").otherwise(tables.kind_of("label"))
    return (features.withColumn("kind", kind)
            .withColumn("fid", number(r"^bbob_f(\d+)_")).withColumn("iid", number(r"_ins(\d+)$")))


def family_status(features: DataFrame) -> DataFrame:
    """``(label, family, n_features, n_missing, status)``: a family without any value is reported as failed."""
    family = F.regexp_extract("feature", r"^([a-z_]+)\.", 1)
    return (features.groupBy("label", family.alias("family"))
            .agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("value").isNull()).alias("n_missing"))
            .withColumn("status", F.when(F.col("n_missing") == F.col("n_features"), "failed").otherwise("ok")))


def compute_features_many(study: Study, doe: DataFrame) -> Computed:
    """Features of the responses, the benchmark functions and the generated functions on the same points.

    A function that cannot be characterised has NULL features and a line in ``status``; the
    others go on.
    """
    rescale.validate_doe(doe, study.bounds, study.responses, study.target, study.normalize_x)
    keep = [study.id_col, *study.x, *study.responses]
    clean = rescale.preprocess(doe.select(*[col(c) for c in keep]), study.bounds, study.id_col,
                               study.target if study.normalize_x else None)
    points = cut(spread(clean, study.id_col))
    problems = [f"{study.problem_label}_{c}" for c in study.responses]
    wide = points.select(study.id_col, *[col(c) for c in study.x], *[col(c).alias(l) for c, l in zip(study.responses, problems)])
    labels, catalogue = list(problems), None
    if study.functions:
        wide, names = evaluate.benchmark_columns(wide, study.x, study.functions)
        labels += names
    if study.generated:
        catalogue, wide, _ = first_n_valid(wide, study.x, study.generated, study.seed, id_col=study.id_col)
        labels += [f"rgf{i + 1}" for i in range(study.generated)]
    wide = cut(wide)
    sampled = (sample.subsample(wide, study.id_col, study.ratio, study.repeats, study.seed) if study.bootstrap
               else sample.full_sample(wide))
    ready = cut(rescale.normalize_response(sampled, ["rep"], labels, bound=len(study.reps)) if study.normalize_y else sampled)
    n = ready.groupBy("rep").count().agg(F.max("count")).first()[0]
    rows = compute_features(ready, study.x, labels, study.box, study.reps, n, study.id_col, study.blocks, study.families)
    features = cut(with_kind(rows, study.problem_label))
    return Computed(features, family_status(features), catalogue, points)


def store_features(study: Study, doe: DataFrame, path: str, fmt: str = "parquet") -> Computed:
    """Compute a study and keep its features, one folder per population and label."""
    done = compute_features_many(study, doe)
    write_features(done.features, path, fmt)
    return done


def pivot_features(features: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row per label and repeat, one column per feature (their list is read from the table)."""
    names = sorted(r["feature"] for r in features.select("feature").distinct().collect())
    wide = (features.groupBy("label", "kind", "fid", "iid", "rep").pivot("feature", names).agg(F.first("value")))
    return cut(wide), names
