"""The p-queries of the operators in this subpackage, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagweave.llm import clusters, leakage, packing, runs, splits, splitting, vectors
from bagweave.llm.components import random_mate
from bagweave.session import materialize, read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = vectors.similar_pairs(read_table(spark, d, "sift_combined"), "feature_id", "feature", dim=128, k=10, max_distance=0.12)
    return pairs.select(F.col("a").alias("feature_a"), F.col("b").alias("feature_b"))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar features, of all, of every feature whose id is divisible by 50."""
    return vectors.nearest(read_table(spark, d, "sift_combined"), "feature_id", "feature", dim=128, k=10, query_every=50).withColumnRenamed("id", "feature_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_bags(read_table(spark, d, "bags"), read_table(spark, d, "entities"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_splits(read_table(spark, d, "bags"), read_table(spark, d, "entities"))


def _alike(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Links and components of features within 0.45 and of points of a split within 0.5."""
    features = clusters.vector_links(read_table(spark, d, "sift_combined"), "feature_id", "feature", dim=128, max_distance=0.45)
    links = materialize(clusters.point_links(read_table(spark, d, "points"), "point_id", "split_id", "point", 0.5))
    return {"sift_combined": features, "points": (links, random_mate(links, finish_edges=clusters.FINISH))}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (clusters.clusters_of(parts, 12).select(F.lit(src).alias("src"), "rec_id", "cluster_id") for src, (_, parts) in _alike(spark, d).items())
    return a.unionByName(b)


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members (its medoid first) of each cluster after loose ones are split."""
    alike = _alike(spark, d)
    features, points = read_table(spark, d, "sift_combined"), clusters.usable_points(read_table(spark, d, "points"), "point_id", "split_id", "point")
    vectors_of = {"sift_combined": (features.where("feature_id is not null").select(F.col("feature_id").cast("bigint").alias("id"), F.col("feature").cast("array<double>").alias("vec")), 0.45, 128), "points": (points.select("id", F.col("point").alias("vec")), 0.5, None)}
    made = [clusters.typical_members(clusters.clusters_of(alike[src][1], 12), *of).select(F.lit(src).alias("src"), "cluster_id", "medoid", "size", "typical") for src, of in vectors_of.items()]
    return made[0].unionByName(made[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(read_table(spark, d, "states")).select("game_id", "first_idx", "last_idx")


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(read_table(spark, d, "states"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing had to place in more than one container."""
    placed = packing.pack_texts(read_table(spark, d, "documents"), "doc_id", "text")
    held = placed.groupBy("id").agg(F.min("container_id").alias("first"), F.max("container_id").alias("last"))
    return held.where("first < last").select(F.col("id").alias("doc_id"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(read_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(read_table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id")).distinct()


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(read_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p3_found": p3_found, "p3_splits": p3_splits, "p4_found": p4_found, "p4_clusters": p4_clusters, "p5_found": p5_found, "p5_runs": p5_runs, "p6_found": p6_found, "p6_containers": p6_containers, "p7_found": p7_found, "p8_found": p8_found, "p8_pieces": p8_pieces}


_NEAR = """
with once as (
  select *, row_number() over (partition by game_id, state_idx order by received_at) as copy from states
), ordered as (
  select game_id, state_idx, time, subtime, new_session, list_sort(players) as p,
    lag(list_sort(players)) over (partition by game_id order by time, subtime, state_idx) as q
  from once where copy = 1
), linked as (
  select *, not new_session and len(p) > 0 and len(p) = len(q) and len(list_filter(list_zip(p, q), lambda z:
    z[1].team = z[2].team and z[1].index = z[2].index
    and abs(z[1].location[1] - z[2].location[1]) <= 0.05 + 1e-9 and abs(z[1].location[2] - z[2].location[2]) <= 0.05 + 1e-9
    and least(abs(z[1].orientation - z[2].orientation) % 360, 360 - abs(z[1].orientation - z[2].orientation) % 360) <= 2 + 1e-9
    and coalesce(z[1].kick_power, 'nan'::double) = coalesce(z[2].kick_power, 'nan'::double)
    and coalesce(z[1].kick_angle, 'nan'::double) = coalesce(z[2].kick_angle, 'nan'::double))) = len(p) as link
  from ordered
), numbered as (
  select *, sum(case when link then 0 else 1 end) over (partition by game_id order by time, subtime, state_idx rows unbounded preceding) as run from linked
), made as (
  select game_id, arg_min(state_idx, (time, subtime, state_idx)) as first_idx, arg_max(state_idx, (time, subtime, state_idx)) as last_idx,
    count(*) as n_states, arg_max(time, (time, subtime, state_idx)) - arg_min(time, (time, subtime, state_idx)) as duration_time,
    arg_max(subtime, (time, subtime, state_idx)) - arg_min(subtime, (time, subtime, state_idx)) as duration_subtime
  from numbered group by game_id, run having count(*) >= 2
)
"""

_RELATED = """
with recursive own as (
  select distinct e.bag_id as list_id, e.entity_id from entities e
  where e.entity_id is not null and e.entity_id <> 0 and e.bag_id in (select bag_id from bags where list_bag_id is null)
), held as (
  select distinct b.bag_id, coalesce(b.list_bag_id, b.bag_id) as list_id from bags b
  where coalesce(b.list_bag_id, b.bag_id) in (select bag_id from bags where list_bag_id is null)
), shared as (
  select entity_id from own group by entity_id having count(*) > 1
), star as (
  select o.list_id as a, min(o.list_id) over (partition by o.entity_id) as b from own o join shared using (entity_id)
), edge as (
  select a, b from star union select b, a from star
), reach(a, b) as (
  select distinct list_id, list_id from held
  union
  select r.a, e.b from reach r join edge e on r.b = e.a
), root as (
  select a as list_id, min(b) as root from reach group by a
), grouped as (
  select bag_id, min(bag_id) over (partition by root) as group_id, count(*) over (partition by root) as n from held join root using (list_id)
)
select bag_id, group_id from grouped where n > 1
"""


_PAIRS = """
with good as (
  select distinct feature_id, feature from sift_combined where feature_id is not null and len(feature) = 128
    and len(list_filter(feature, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(feature, lambda x: x <> 0)) > 0
), scaled as (
  select feature_id, list_transform(feature, lambda x: x / sqrt(list_sum(list_transform(feature, lambda y: y * y))))::double[128] as v from good
), near as (
  select a.feature_id as a, b.feature_id as b, array_distance(a.v, b.v) as d from scaled a join scaled b on a.feature_id <> b.feature_id
  where array_distance(a.v, b.v) <= 0.12 + 1e-6
), ranked as (
  select a, b, row_number() over (partition by a order by d, b) as n from near
)
select distinct least(a, b) as feature_a, greatest(a, b) as feature_b from ranked where n <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _PAIRS,
        "p3_found": _RELATED,
        "p5_found": _NEAR + "select game_id, first_idx, last_idx from made",
        "p5_runs": _NEAR + "select * from made",
    }
