"""Leaf counts, scores and greedy leaf probabilities; threshold sweeps as window queries."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bagweave.functions import vectors as V
from bagweave.session import materialize

#: A later leaf's probability stays below the previous one by at least this share.
STEP = 1e-6
#: Words of a set of leaves, and bits of each.
WORDS, WORD_BITS = 4, 62


def leaf_table(df: DataFrame, leaves: list) -> DataFrame:
    """(leaf_id, probability, strength) of a tree's leaves; as many rows as the tree has leaves."""
    return df.sparkSession.createDataFrame([(x.id, float(x.probability), float(x.strength)) for x in leaves], "leaf_id int, probability double, strength double")


def max_leaf_bags(leaf_bags: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf_id, bag_id, label): each bag once, at the leaf of highest probability that it reaches (first on a tie).

    A partial aggregate by bag, not a window: at most one row a bag and task is shuffled.
    """
    reached = leaf_bags.join(F.broadcast(leaves), "leaf_id")
    return reached.groupBy("bag_id", "label").agg(F.max_by("leaf_id", F.struct("probability", -F.col("leaf_id"))).alias("leaf_id")).select("leaf_id", "bag_id", "label")


def max_leaf_counts(leaf_bags: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf_id, probability, strength, pos, neg): leaves that no bag reaches count 0."""
    best = max_leaf_bags(leaf_bags, leaves)
    counts = best.groupBy("leaf_id").agg(F.sum(F.col("label").cast("bigint")).alias("pos"), F.sum((~F.col("label")).cast("bigint")).alias("neg"))
    return leaves.join(counts, "leaf_id", "left").select("leaf_id", "probability", "strength", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("pos", "neg")))


def log_metric(counts: DataFrame) -> DataFrame:
    """(metric): sum over leaves of pos ln p + neg ln(1 - p), zero counts left out."""
    return counts.agg(F.sum(V.log_score(F.col("probability"), F.col("pos"), F.col("neg"))).alias("metric"))


def signatures(leaf_bags: DataFrame) -> Counter:
    """How many bags reach exactly which leaves, by label: the only thing that greedy probabilities depend on.

    At most 2 x 2^leaves rows come to the driver, whatever the number of bags.
    """
    # sets as bits of a few words, which an aggregate holds in fixed space; the ids of larger trees as lists
    def word(w: int) -> Column:
        return F.coalesce(F.bit_or(F.when(F.floor(F.col("leaf_id") / WORD_BITS) == w, F.expr(f"shiftleft(1L, cast(leaf_id % {WORD_BITS} as int))"))), F.lit(0).cast("bigint"))

    names = [f"w{w}" for w in range(WORDS)]
    bits = leaf_bags.groupBy("bag_id", "label").agg(*(word(w).alias(n) for w, n in enumerate(names)), F.max("leaf_id").alias("top"))
    rows = bits.groupBy(*names, "label").agg(F.count("*").alias("n"), F.max("top").alias("top")).collect()
    if all(r["top"] < WORDS * WORD_BITS for r in rows):
        return Counter({(tuple(w * WORD_BITS + b for w, n in enumerate(names) for b in range(WORD_BITS) if r[n] >> b & 1), r["label"]): r["n"] for r in rows})
    sets = leaf_bags.groupBy("bag_id", "label").agg(F.sort_array(F.collect_set("leaf_id")).alias("leaves"))
    return Counter({(tuple(r["leaves"]), r["label"]): r["n"] for r in sets.groupBy("leaves", "label").agg(F.count("*").alias("n")).collect()})


def greedy_probabilities(counts: Counter, leaf_ids: list[int]) -> dict[int, tuple[float, float, int, int]]:
    """{leaf: (probability, strength, pos, neg)}: leaves are fixed one by one, the largest smoothed share first.

    A fixed leaf uses up its bags; the share of an open leaf is taken over its unused bags, and stays below the last one.
    """
    left, open_, before, out = Counter(counts), list(leaf_ids), 1.0, {}
    while open_:
        best = None
        for leaf in open_:
            pos = sum(n for (reached, label), n in left.items() if label and leaf in reached)
            neg = sum(n for (reached, label), n in left.items() if not label and leaf in reached)
            p = (pos + 1) / (pos + neg + 2)
            if p >= before:
                p = (1 - STEP) * before
            if best is None or p > best[0]:
                best = (p, leaf, pos, neg)
        p, leaf, pos, neg = best
        out[leaf] = (p, float(pos + neg + 2), pos, neg)
        open_.remove(leaf)
        left = Counter({k: n for k, n in left.items() if leaf not in k[0]})
        before = p
    return out


def score_of(probabilities: dict[int, tuple[float, float, int, int]]) -> float:
    return sum((pos * math.log(p) if pos else 0.0) + (neg * math.log(1 - p) if neg else 0.0) for p, _, pos, neg in probabilities.values())


def best_leaf(counts: Counter, current: dict[int, float], leaf_ids: list[int]) -> int | None:
    """The leaf whose perfect split would score highest: its positive bags stay, its negative ones go to another leaf."""
    order = sorted(leaf_ids, key=lambda x: (-current[x], leaf_ids.index(x)))
    most: dict[int, Counter] = {x: Counter() for x in leaf_ids}
    for (reached, label), n in counts.items():
        top = next((x for x in order if x in reached), None)
        if top is not None:
            most[top][(reached, label)] += n
    fake, best = max(leaf_ids, default=0) + 1, None
    for leaf in leaf_ids:
        if not most[leaf]:
            continue
        changed = Counter()
        for (reached, label), n in counts.items():
            if leaf not in reached:
                changed[(reached, label)] += n
            else:
                stays = n if label and (reached, label) in most[leaf] else 0
                rest = tuple(x for x in reached if x != leaf)
                changed[(reached, label)] += stays
                changed[(tuple(sorted({*rest, fake})), label)] += n - stays
        score = score_of(greedy_probabilities(+changed, [*leaf_ids, fake]))
        if best is None or score > best[0]:
            best = (score, leaf)
    return best and best[1]


# threshold sweep


def near_far(points: DataFrame, center: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(…by, bag_id, label, near, far, near_point): least and greatest distance of each bag's points to a centre.

    Points with NaN don't count; bags without others are left out.
    """
    d = points.where(~V.any_nan(F.col("point"))).withColumn("distance", V.distance(F.col("point"), center))
    return d.groupBy(*by, "bag_id", "label").agg(F.min("distance").alias("near"), F.max("distance").alias("far"), F.min_by("point", "distance").alias("near_point"))


def sweep(distances: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each distinct edge distance, with how many bags of each label are inside, straddling and outside.

    A bag opens at its near edge and closes at its far edge. Ties are folded by the aggregate before the running sums.
    These are sums within ranges of distances, each a task of its own, on top of the totals of the ranges before.
    """
    pos, neg = F.col("label").cast("bigint"), (~F.col("label")).cast("bigint")
    edges = distances.select(*by, F.explode(F.array(F.struct(F.col("near").alias("d"), pos.alias("po"), neg.alias("no"), F.lit(0).cast("bigint").alias("pc"), F.lit(0).cast("bigint").alias("nc")), F.struct(F.col("far").alias("d"), F.lit(0).cast("bigint").alias("po"), F.lit(0).cast("bigint").alias("no"), pos.alias("pc"), neg.alias("nc")))).alias("e"))
    return sweep_edges(edges.groupBy(*by, F.col("e.d").alias("distance")).agg(*(F.sum(f"e.{c}").alias(c) for c in ("po", "no", "pc", "nc"))), by)


def sweep_edges(folded: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`sweep` of distinct distances with how many bags of each label open and close there: po, no, pc, nc."""
    parts = ("po", "no", "pc", "nc")
    # a bucket is a range of distances; it is written, since its bounds must be the same for its sums and its rows
    ranged = folded.repartitionByRange(*(F.col(c) for c in (*by, "distance"))).withColumn("bucket", F.spark_partition_id())
    rows = materialize(ranged)
    # a row for each bucket (and each `by` that it has): as many as there are partitions and `by`s
    totals = rows.groupBy(*by, "bucket").agg(*(F.sum(c).alias(c) for c in parts), F.min("distance").alias("least")).collect()
    made, last, sums = [], object(), None
    for row in sorted(totals, key=lambda r: (repr([r[c] for c in by]), r["bucket"])):
        key = tuple(row[c] for c in by)
        name = repr(key)
        if key != last:
            last, sums = key, [0] * len(parts)
        if made and made[-1]["key"] == key:
            made[-1]["after"] = row["least"]
        made.append({"key": key, "name": name, "bucket": row["bucket"], "before": list(sums), "after": None})
        sums = [x + (row[c] or 0) for x, c in zip(sums, parts, strict=True)]
        made[-1]["ends"] = sums
    whole = {m["name"]: m["ends"] for m in made}
    small = [(*m["key"], m["bucket"], *m["before"], m["after"], *whole[m["name"]][:2]) for m in made]
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("bucket", T.IntegerType()), *(T.StructField(f"b_{c}", T.LongType()) for c in parts), T.StructField("after", rows.schema["distance"].dataType), T.StructField("all_pos", T.LongType()), T.StructField("all_neg", T.LongType())])
    before = F.broadcast(folded.sparkSession.createDataFrame(small, schema))
    order = Window.partitionBy(*by, "bucket").orderBy("distance")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.select(*by, "bucket", "distance", *(F.sum(c).over(run).alias(f"w_{c}") for c in parts), F.lead("distance").over(order).alias("following"))
    sums = within.join(before, [*by, "bucket"]).select(*by, "distance", F.coalesce("following", "after").alias("next"), *((F.col(f"b_{c}") + F.col(f"w_{c}")).alias(f"s_{c}") for c in parts), "all_pos", "all_neg")
    return sums.select(*by, "distance", "next", F.col("s_pc").alias("y_pos"), F.col("s_nc").alias("y_neg"), (F.col("s_po") - F.col("s_pc")).alias("m_pos"), (F.col("s_no") - F.col("s_nc")).alias("m_neg"), (F.col("all_pos") - F.col("s_po")).alias("n_pos"), (F.col("all_neg") - F.col("s_no")).alias("n_neg"))


def _share(pos: Column, neg: Column) -> Column:
    return F.when(pos + neg > 0, F.try_divide(pos.cast("double"), (pos + neg).cast("double"))).otherwise(0.0)


def scored(sweep_rows: DataFrame, seed_label: Column) -> DataFrame:
    """Adds score (NULL where the cut isn't admissible) and threshold to a sweep.

    Straddling bags go to the side with the higher optimistic share; the yes side must have the higher share exactly if
    the seed is positive.
    """
    y_pos, y_neg, m_pos, m_neg, n_pos, n_neg = (F.col(c) for c in ("y_pos", "y_neg", "m_pos", "m_neg", "n_pos", "n_neg"))
    hot = _share(y_pos + m_pos, y_neg + m_neg) > _share(n_pos + m_pos, n_neg + m_neg)
    yes_pos, yes_neg = y_pos + F.when(hot, m_pos).otherwise(0), y_neg + F.when(hot, m_neg).otherwise(0)
    no_pos, no_neg = n_pos + F.when(hot, 0).otherwise(m_pos), n_neg + F.when(hot, 0).otherwise(m_neg)
    score = V.log_score(_share(yes_pos, yes_neg), yes_pos, yes_neg) + V.log_score(_share(no_pos, no_neg), no_pos, no_neg)
    return sweep_rows.withColumn("score", F.when(hot == seed_label, score)).withColumn("threshold", F.when(F.col("next").isNull(), F.col("distance")).otherwise((F.col("distance") + F.col("next")) / 2))


def best_threshold(distances: DataFrame, seed_label: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(…by, score, threshold) of the first best cut; without an admissible one, -infinity and 0."""
    return best_of(sweep(distances, by), seed_label, by)


def best_of(sweep_rows: DataFrame, seed_label: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """`best_threshold` of a sweep."""
    rows = scored(sweep_rows, seed_label)
    # rounding makes equal scores equal, whatever the order of summing
    best = rows.groupBy(*by).agg(F.max_by(F.struct("score", "threshold"), F.when(F.col("score").isNotNull(), F.struct(F.round("score", 9), -F.col("distance")))).alias("best"))
    return best.select(*by, F.coalesce("best.score", F.lit(-math.inf)).alias("score"), F.coalesce(F.when(F.col("best.score").isNotNull(), F.col("best.threshold")), F.lit(0.0)).alias("threshold"))


def near_points(distances: DataFrame, threshold: Column, seed_label: Column) -> DataFrame:
    """Bags whose near point is within the threshold, and whether their label agrees with the seed's."""
    return distances.where(F.col("near") <= threshold).select("bag_id", "label", "near", "near_point", (F.col("label") == seed_label).alias("agrees"))
