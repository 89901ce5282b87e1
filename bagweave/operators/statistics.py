"""Sample statistics, densities, Gaussian models and random sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagweave.functions import vectors as V
from bagweave.session import materialize


def vector_aggregate(df: DataFrame, vec_col: str, dims: int, how: str) -> DataFrame:
    """(value) array of min, max or mean in each dimension; NaN for no rows."""
    of = {"min": F.min, "max": F.max, "mean": F.avg}[how]
    return df.agg(F.array(*(F.coalesce(of(F.get(vec_col, F.lit(i)).cast("double")), V.nan()) for i in range(dims))).alias("value"))


def variance(df: DataFrame, x: str) -> DataFrame:
    return df.agg(F.var_samp(x).alias("variance"))


def covariance(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.covar_samp(x, y).alias("covariance"))


def gaussian_mle(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(mean array, cov array of arrays) of points: sample mean and covariance with n - 1, in one aggregate."""
    return df.agg(F.array(*(F.avg(c) for c in columns)).alias("mean"), F.array(*(F.array(*(F.covar_samp(a, b) for b in columns)) for a in columns)).alias("cov"))


def kernel_summary(points: DataFrame) -> DataFrame:
    """(n, mean) of the positive points without NaN, in the first dimension; an error without any."""
    used = points.where(F.col("label") & ~V.any_nan(F.col("point")))
    return used.agg(F.count("*").alias("n"), F.max(F.get("point", F.lit(0))).alias("greatest"), F.avg(F.get("point", F.lit(0))).alias("mean")).select(F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no positive points"))).alias("n"), "greatest", "mean")


#: Seeds that are broadcast at once.
SEED_BLOCK = 10_000


def against_seeds(points: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every point with every seed. The seeds, a written table, go in blocks of about SEED_BLOCK, each of which is
    broadcast, so what is broadcast is bounded however many seeds there are."""
    blocks = max(1, -(-seeds.count() // SEED_BLOCK))
    block = F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in seeds.columns)), F.lit(blocks))
    made = [points.crossJoin(F.broadcast(seeds.where(block == b))) for b in range(blocks)]
    return reduce(DataFrame.unionByName, made)


def diverse_density(points: DataFrame, bag_limit: int = 4) -> DataFrame:
    """(seed_bag, seed_point, score): the points of the first positive bags, scored as common centres; least is best.

    Each positive bag adds its least squared distance to the seed, each negative one -ln(1 - exp(-that)). The seeds
    come from `bag_limit` bags; all points are compared with them.
    """
    good = points.where(~V.any_nan(F.col("point")))
    bags = good.where("label").select("bag_id").distinct().orderBy("bag_id").limit(bag_limit)
    seeds = materialize(good.join(F.broadcast(bags), "bag_id", "left_semi").select(F.col("bag_id").alias("seed_bag"), F.col("point").alias("seed_point")).distinct())
    nearest = against_seeds(good, seeds).groupBy("seed_bag", "seed_point", "bag_id", "label").agg(F.min(V.squared_distance(F.col("point"), F.col("seed_point"))).alias("d"))
    inside = F.lit(1.0) - F.exp(-F.col("d"))
    cost = F.when(F.col("label"), F.col("d")).otherwise(F.when(inside > 0, -F.ln(F.when(inside > 0, inside))).otherwise(F.lit(math.inf)))
    return nearest.groupBy("seed_bag", "seed_point").agg(F.sum(cost).alias("score"))


def densest_point(scores: DataFrame) -> DataFrame:
    """(seed_bag, seed_point, score) of the least score; of equal ones that of the first bag and least point."""
    return scores.groupBy().agg(F.min(F.struct("score", "seed_bag", "seed_point")).alias("best")).where("best is not null").select("best.seed_bag", "best.seed_point", "best.score")


def nearest_in_bags(points: DataFrame, mean: Sequence[float], precision_of: Sequence[Sequence[float]]) -> DataFrame:
    """(bag_id, label, d2, point): the least squared Mahalanobis distance of each bag's points, and the point that has it
    (the least of equally near ones). Points with NaN don't count; bags without others are left out."""
    good = points.where(~V.any_nan(F.col("point"))).withColumn("d2", V.mahalanobis_squared(F.col("point"), mean, precision_of))
    best = good.groupBy("bag_id", "label").agg(F.min(F.struct("d2", "point")).alias("best"))
    return best.select("bag_id", "label", "best.d2", "best.point")


def kernel_density(points: DataFrame, dims: int = 1, steps: int = 31) -> DataFrame:
    """(cell array, density) on a grid of `steps` places in each dimension, from the least value on; the greatest one
    is not a place of the grid. With h the least step of all dimensions, each point whose squared distance to a place
    is below 16 h adds exp(-distance / (2 h^dims)) / (2 pi h)^(dims / 2). A point meets only the places in reach of it,
    which are counted off from its own; sums are made before the shuffle.
    """
    good = points.where(~V.any_nan(F.col("point"))).select("point")
    bounds = good.agg(*(F.min(F.get("point", F.lit(i))).alias(f"lo{i}") for i in range(dims)), *(F.max(F.get("point", F.lit(i))).alias(f"hi{i}") for i in range(dims)))
    bounds = bounds.select("*", *((F.col(f"hi{i}") - F.col(f"lo{i}")).alias(f"wide{i}") for i in range(dims)))
    bounds = bounds.select("*", (F.array_min(F.array(*(f"wide{i}" for i in range(dims)))) / steps).alias("h"))
    step = [F.col(f"wide{i}") / steps for i in range(dims)]
    place = [F.col(f"lo{i}") + step[i] * F.col(f"s{i}") for i in range(dims)]
    # one row of bounds
    near = good.crossJoin(F.broadcast(bounds)).where("h > 0")
    for i in range(dims):
        own, reach = (F.get("point", F.lit(i)) - F.col(f"lo{i}")) / step[i], 4 * F.sqrt("h") / step[i]
        first, last = F.greatest(F.lit(0), F.floor(own - reach).cast("int")), F.least(F.lit(steps - 1), F.ceil(own + reach).cast("int"))
        near = near.withColumn(f"s{i}", F.explode(F.when(first <= last, F.sequence(first, last))))
    near = near.withColumn("d", V.squared_distance(F.col("point"), F.array(*place))).where(F.col("d") < 16 * F.col("h"))
    weight = V.divide(F.exp(F.lit(-0.5) * V.divide(F.col("d"), F.pow("h", F.lit(float(dims))))), F.pow(2 * math.pi * F.col("h"), F.lit(0.5 * dims)))
    at = [f"s{i}" for i in range(dims)]
    sums = near.groupBy(*at).agg(F.sum(weight).alias("sum"))
    grid = bounds
    for i in range(dims):
        grid = grid.withColumn(f"s{i}", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return grid.join(sums, at, "left").select(F.array(*place).alias("cell"), F.coalesce("sum", F.lit(0.0)).alias("density"))


def range_match(df: DataFrame, vec_col: str, center: Sequence[float], radius: float) -> DataFrame:
    return df.where(V.distance(F.col(vec_col).cast("array<double>"), F.array(*(F.lit(float(c)) for c in center))) <= radius)


# random sampling


def gaussian_rows(df: DataFrame, mean: Sequence[float], cov: Sequence[Sequence[float]], seed: int) -> Column:
    """A Gaussian vector for each row: mean + L z, with the root L of the covariance as literals."""
    root = np.linalg.cholesky(np.asarray(cov, float))
    z = [F.randn(seed + i) for i in range(len(mean))]
    return F.array(*(F.lit(float(mean[i])) + sum((z[j] * float(root[i, j]) for j in range(i + 1)), F.lit(0.0)) for i in range(len(mean))))


def uniform_rows(bounds: Sequence[tuple[float, float]], seed: int) -> Column:
    return F.array(*(F.lit(float(a)) + F.lit(float(b - a)) * F.rand(seed + i) for i, (a, b) in enumerate(bounds)))


#: Names of the distributions that `sample` offers, all methods of numpy's Generator; fixed values.
DISTRIBUTIONS = (
    "beta binomial chisquare exponential f gamma geometric gumbel hypergeometric laplace logistic lognormal logseries negative_binomial "
    "noncentral_chisquare noncentral_f normal pareto poisson power rayleigh standard_cauchy standard_exponential standard_gamma standard_normal "
    "standard_t triangular uniform vonmises wald weibull zipf"
).split()


def sample(df: DataFrame, distribution: str, params: Sequence[float], seed: int = 0) -> DataFrame:
    """df with a column `sample`; every row's number depends on the seed and its partition."""
    if distribution not in DISTRIBUTIONS:
        raise ValueError(f"no distribution {distribution}")
    args = tuple(params)

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = None
        for part in parts:
            if rng is None:
                rng = np.random.default_rng([seed, int(part["__part"].iloc[0]) if len(part) else 0])
            yield part.drop(columns="__part").assign(sample=np.asarray(getattr(rng, distribution)(*args, size=len(part)), dtype=float))

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("sample", DoubleType())])
    return df.withColumn("__part", F.spark_partition_id()).mapInPandas(draw, schema)


def multinomial(n: int, p: Sequence[float], draws: int, seed: int = 0) -> np.ndarray:
    if abs(sum(p) - 1) > 1e-6:
        raise ValueError("probabilities must add up to 1")
    p = np.asarray(p, float)
    return np.random.default_rng(seed).multinomial(n, p / p.sum(), size=draws)


def bootstrap_p_value(candidate: Sequence[tuple[int, int, float]], previous: Sequence[tuple[int, int, float]], repeats: int = 10_000, seed: int = 0) -> float:
    """1 - share of resamples in which the candidate scores higher than the previous tree.

    Each tree: (neg, pos, probability) of its leaves on the validation bags. The counts of a resample are multinomial;
    what is drawn is bounded by the trees, not by the bags.
    """

    def scores(leaves, rng):
        counts = np.array([c for neg, pos, _ in leaves for c in (neg, pos)], float)
        n = int(counts.sum())
        weights = np.array([w for _, _, p in leaves for w in (math.log(1 - p) if p < 1 else -math.inf, math.log(p) if p > 0 else -math.inf)])
        drawn = rng.multinomial(n, counts / n, size=repeats)
        return np.where(drawn > 0, drawn * np.where(np.isfinite(weights), weights, -1e300), 0.0).sum(1)

    rng = np.random.default_rng(seed)
    return 1.0 - float((scores(candidate, rng) > scores(previous, rng)).mean())


# matrices, for models of a few dimensions


def condition(matrix: np.ndarray, most: float) -> tuple[np.ndarray, float]:
    """(matrix with its condition number brought to `most` by a diagonal shift, its number before)."""
    size = np.abs(np.linalg.eigvals(matrix))
    old = float(size.max() / size.min()) if size.min() > 0 else math.inf
    if old > most:
        matrix = matrix + np.eye(len(matrix)) * (size.max() - size.min() * most) / (most - 1)
    return matrix, old


def precision(cov: np.ndarray) -> np.ndarray:
    return np.linalg.inv(cov)


def grow_volume(points: pd.DataFrame, seed_row: int, most_condition: float | None = None, max_rounds: int = 1) -> tuple[list[int], float]:
    """Rows of a bag's neighbourhood that a Gaussian around a seed point takes in, and the two-leaf log score reached.

    points: bag_id, label, point. In each round the nearest point of each bag is tried in addition to those taken, and
    the one is kept that scores best when bags are inside if their nearest point is as near as the farthest taken one.
    """
    x = np.array(points["point"].tolist(), float)
    bag, label = points["bag_id"].to_numpy(), points["label"].to_numpy(bool)
    taken, dims, best = [seed_row], x.shape[1], -math.inf
    for _ in range(max_rounds):
        step = None
        cov = np.cov(x[taken].T) if len(taken) > 1 else np.eye(dims)
        cov, _ = condition(np.atleast_2d(cov), most_condition or dims * dims + 1)
        inverse, mean = precision(cov), x[taken].mean(0)
        d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
        order = pd.DataFrame({"bag": bag, "d": d}).groupby("bag")["d"]
        nearest = order.idxmin()
        for row in nearest:
            if row in taken:
                continue
            inside = order.min() <= max(d[[*taken, row]])
            labels = pd.Series(label, index=bag).groupby(level=0).first()
            score = 0.0
            for side in (inside, ~inside):
                pos, neg = int((labels & side).sum()), int((~labels & side).sum())
                n = pos + neg
                score += (pos * math.log(pos / n) if pos else 0.0) + (neg * math.log(neg / n) if neg else 0.0)
            if step is None or score > step[0]:
                step = (score, row)
        if step is None or step[0] <= best:
            break
        best = step[0]
        taken.append(int(step[1]))
    return taken, best
