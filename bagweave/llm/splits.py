"""Train, validation and test splits that keep related bags together.

Bags are related when they have the same entity list or their lists share an entity, directly or through other bags. A
list that `list_bag_id` shares is one list, so its bags stay together even if only dummies stand in it. The components
are found by random-mate contraction; whole components are then dealt to the splits by cumulative weight within strata of their
share of true labels.

Results for special input: rows without bag are left out; dummies (entity 0 or NULL), and rows of bags that the table
of bags doesn't have, link nothing; a bag that shares the list of a bag which has no list of its own, or isn't in the table, is related to
none; copies count once; a bag without label counts by its weight only; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagweave.llm.components import random_mate
from bagweave.session import materialize

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: A component above this share of all bags is placed by itself; there are fewer than 1 / GIANT of them.
GIANT = 0.01
_BUCKETS = 512
#: Edges left over by the rounds of contraction that one task contracts at once; a dozen rounds would go to so few.
FINISH = 4096


def bag_components(bags: DataFrame, entities: DataFrame, seed: int = 17) -> DataFrame:
    """(bag_id, root) for each bag whose list is known; root is equal for related bags."""
    held = bags.where("bag_id is not null").groupBy("bag_id").agg(F.max("list_bag_id").alias("shared"))
    held = materialize(held)
    owners = held.where("shared is null").select(F.col("bag_id").alias("list_id"))
    real = entities.where("entity_id is not null and entity_id <> 0").select(F.col("bag_id").alias("list_id"), "entity_id").distinct()
    rows = materialize(real.join(owners, "list_id", "left_semi"))
    first = rows.groupBy("entity_id").agg(F.min("list_id").alias("u"), F.count("*").alias("n")).where("n > 1")
    edges = rows.join(first, "entity_id").select("u", F.col("list_id").alias("v"))
    labels = random_mate(edges, seed, FINISH)
    lists = owners.join(labels, F.col("list_id") == F.col("v"), "left").select("list_id", F.coalesce("root", "list_id").alias("root"))
    return held.select("bag_id", F.coalesce("shared", "bag_id").alias("list_id")).join(lists, "list_id").select("bag_id", "root")


def related_bags(bags: DataFrame, entities: DataFrame, seed: int = 17) -> DataFrame:
    """(bag_id, group_id) for each bag that is related to another one; group_id is the smallest bag_id of its group."""
    members = materialize(bag_components(bags, entities, seed))
    groups = members.groupBy("root").agg(F.min("bag_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return members.join(groups, "root").select("bag_id", "group_id")


def _split_of(position, shares: dict[str, float]):
    """The split in whose part of [0, 1] a position falls."""
    total, at, out = sum(shares.values()) or 1.0, 0.0, None
    names = [k for k in shares if shares[k] > 0] or list(shares)
    for k in names[:-1]:
        at += shares[k] / total
        out = F.when(position < at, k) if out is None else out.when(position < at, k)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def grouped_splits(bags: DataFrame, entities: DataFrame, shares: dict[str, float] | None = None, seed: int = 17) -> DataFrame:
    """(bag_id, group_id, split) for every bag: related bags share their split.

    Components above GIANT of all bags go one by one to the split that lacks most; the others fill what remains. They
    are dealt by their cumulative weight in an order that is random within strata of equal share of true labels, so
    each split gets a like share of them. The cumulative weights come from bucket totals and a window within each
    bucket, never from one task.
    """
    shares = shares or SHARES
    plain = bags.where("bag_id is not null").groupBy("bag_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    members = bag_components(bags, entities, seed)
    all_ = plain.join(members, "bag_id", "left").select("bag_id", "label", F.coalesce(F.struct(F.lit(0).alias("kind"), F.col("root").alias("id")), F.struct(F.lit(1).alias("kind"), F.col("bag_id").alias("id"))).alias("part"))
    all_ = materialize(all_.select("bag_id", "label", F.when(F.col("part.id").isNull(), F.struct(F.lit(1).alias("kind"), F.col("bag_id").alias("id"))).otherwise(F.col("part")).alias("part")))
    parts = materialize(all_.groupBy("part").agg(F.min("bag_id").alias("group_id"), F.count("*").alias("weight"), (F.sum("label") / F.count("label")).alias("positive")))
    total = parts.agg(F.sum("weight")).first()[0] or 0
    lacks = {k: s * total / sum(shares.values()) for k, s in shares.items()}
    giants = []
    for row in parts.where(F.col("weight") > GIANT * total).orderBy(F.desc("weight"), "group_id").select("group_id", "weight").collect():
        to = max(lacks, key=lambda k: lacks[k])
        lacks[to] -= row["weight"]
        giants.append((row["group_id"], to))
    rest = parts.where(F.col("weight") <= GIANT * total)
    stratum = F.coalesce(F.ceil(F.col("positive") * 4), F.lit(9))
    place = rest.select("group_id", "weight", stratum.alias("stratum"), F.xxhash64("group_id", F.lit(seed)).alias("hash"))
    place = place.withColumn("bucket", F.pmod("hash", F.lit(_BUCKETS)))
    sums = place.groupBy("stratum", "bucket").agg(F.sum("weight").alias("sum"))
    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("stratum", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"), F.sum("sum").over(Window.partitionBy("stratum")).alias("whole"))
    within = Window.partitionBy("stratum", "bucket").orderBy("hash", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = place.join(F.broadcast(sums), ["stratum", "bucket"]).select("group_id", ((F.col("before") + F.coalesce(F.sum("weight").over(within), F.lit(0)) + F.col("weight") / 2) / F.col("whole")).alias("position"))
    dealt = placed.select("group_id", _split_of(F.col("position"), {k: max(0.0, v) for k, v in lacks.items()}).alias("split"))
    spark = bags.sparkSession
    dealt = dealt.unionByName(spark.createDataFrame(giants, "group_id bigint, split string"))
    return all_.join(parts.select("part", "group_id"), "part").join(dealt, "group_id").select("bag_id", "group_id", "split")
