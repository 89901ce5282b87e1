"""Filling containers of fixed capacity with items, by exact-complement hashing over the histogram of lengths.

Only how often each length occurs decides how containers are filled, so the plan is made from at most `capacity`
counts, however many items there are: for the longest length left, the sums of one, two and three available lengths
that fill its gap exactly are looked up and consumed for as many items as the counts allow; what finds no exact
complement goes best-fit into the smallest gap that holds it. A plan line says how many containers hold which lengths.
Items then find their containers by their rank within their length.

An item above the capacity is cut into full pieces and a rest; no other item is split.

Results for special input: NULL, zero or negative sizes take no space and go to container 0; repeated ids are items of
their own; NULL ids are kept; an empty table needs no container.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagweave.llm.tokens import DEFAULT_VOCABULARY, token_sizes
from bagweave.session import materialize

CAPACITY = 2048
#: Items of one length that one task ranks.
BUCKET_ROWS = 1_000_000


class _Sums:
    """Index of the sums of available lengths, kept up to date while lengths are used up.

    pairs[s] is how many pairs of available lengths add up to s (a length pairs with itself while two of it are left). A
    sum of three is a length and a pair, so the same index answers for it.
    """

    def __init__(self, left: np.ndarray):
        self.left, self.there, self.twice = left, np.zeros(len(left), bool), np.zeros(len(left), bool)
        self.pairs = np.zeros(len(left), np.int64)
        for length in np.flatnonzero(left):
            self.update(int(length))

    def update(self, length: int) -> None:
        """Takes over how many of a length are left."""
        n, size = int(self.left[length]), len(self.left)
        if (n > 0) != self.there[length]:
            self.there[length] = False
            others = np.flatnonzero(self.there[: size - length])
            self.there[length] = n > 0
            self.pairs[others + length] += 1 if n else -1
        if (n > 1) != self.twice[length]:
            self.twice[length] = n > 1
            if 2 * length < size:
                self.pairs[2 * length] += 1 if n > 1 else -1

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair with the longest member."""
        if not self.pairs[gap]:
            return None
        there = self.left[1:gap] > 0
        for a in np.flatnonzero(there & there[::-1])[::-1] + 1:
            if 2 * a != gap or self.left[a] > 1:
                return int(a), int(gap - a)
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """The triple with the longest member."""
        there = np.flatnonzero(self.left[:gap])
        for a in there[self.pairs[gap - there] > 0][::-1]:
            self.left[a] -= 1
            rest = self.pair(int(gap - a))
            self.left[a] += 1
            if rest:
                return int(a), *rest
        return None


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of containers, the lengths in each of them) so that every counted item has its place."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    lines: list[tuple[int, tuple[int, ...]]] = []
    sums, rest = _Sums(left), Counter()
    for length in range(capacity, 0, -1):
        while left[length]:
            gap = capacity - length
            left[length] -= 1
            sums.update(length)
            found = () if gap == 0 else sums.single(gap) or sums.pair(gap) or sums.triple(gap)
            left[length] += 1
            if found is None:
                rest[length] = int(left[length])
                left[length] = 0
                sums.update(length)
                break
            need = Counter((length, *found))
            m = int(min(left[x] // k for x, k in need.items()))
            for x, k in need.items():
                left[x] -= m * k
                sums.update(x)
            lines.append((m, (length, *found)))
    return lines + _best_fit(rest, capacity)


def _best_fit(rest: Counter, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Longest first, into the smallest gap that holds the length; many equal containers at a time."""
    gaps: dict[int, Counter] = {}
    order: list[int] = []

    def put(gap: int, held: tuple[int, ...], m: int) -> None:
        if gap not in gaps:
            gaps[gap] = Counter()
            bisect.insort(order, gap)
        gaps[gap][held] += m

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = min(n, capacity // length)
                m = n // each
                put(capacity - each * length, (length,) * each, m)
                n -= m * each
                continue
            gap = order[at]
            held, have = next(iter(gaps[gap].items()))
            each = min(n, gap // length)
            m = min(have, n // each)
            gaps[gap][held] -= m
            if not gaps[gap][held]:
                del gaps[gap][held]
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            put(gap - each * length, held + (length,) * each, m)
            n -= m * each
    return [(m, held) for of in gaps.values() for held, m in of.items()]


def _places(lines: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first container, number in each container) for each length of each line."""
    rows, used, container = [], Counter(), 0
    for m, held in lines:
        for length, k in Counter(held).items():
            rows.append((length, used[length], used[length] + m * k, container, k))
            used[length] += m * k
        container += m
    return rows


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece_no, n_pieces, size, container_id): every piece of every item, with its container.

    sizes: id, n_tokens. An item above the capacity has n_pieces > 1: full pieces, and the rest if there is one.
    The sizes are made once and written, since the histogram must be complete before the first item is placed.
    """
    spark = sizes.sparkSession
    # the written row number tells equal rows apart
    whole = materialize(sizes.select("id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.monotonically_increasing_id().alias("row")))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    pieces = whole.withColumn("n_pieces", n_pieces).select("id", "row", "n_pieces", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece_no"))
    pieces = pieces.select("id", "row", "piece_no", "n_pieces", F.greatest(F.lit(0), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no").cast("bigint") * capacity)).cast("int").alias("size"))
    sized = pieces.where("size > 0")
    # at most `capacity` rows, however many items
    counts = Counter({r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()})
    places = _places(plan_containers(counts, capacity))
    # a length that many items have is ranked in several buckets, of BUCKET_ROWS items each
    split = spark.createDataFrame([(size, max(1, -(-n // BUCKET_ROWS))) for size, n in counts.items()], "size int, buckets bigint")
    sized = sized.join(F.broadcast(split), "size").withColumn("bucket", F.pmod(F.xxhash64("row", "piece_no"), F.col("buckets"))).drop("buckets")
    start, before = Counter(), []
    for row in sorted(sized.groupBy("size", "bucket").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["size"], r["bucket"])):
        before.append((row["size"], row["bucket"], start[row["size"]]))
        start[row["size"]] += row["n"]
    offsets = spark.createDataFrame(before, "size int, bucket bigint, before bigint")
    table = spark.createDataFrame(places, "size int, rank_0 bigint, rank_1 bigint, first bigint, each int")
    # bounded by the capacity, and by one row for each BUCKET_ROWS items
    by_size = table.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("rank_0", "rank_1", "first", "each"))).alias("lines"))
    rank = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id", "row", "piece_no")) - 1
    ranked = sized.withColumn("rank", rank).join(F.broadcast(offsets), ["size", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    line = F.filter("lines", lambda x: (x["rank_0"] <= F.col("rank")) & (F.col("rank") < x["rank_1"]))[0]
    placed = ranked.join(F.broadcast(by_size), "size").withColumn("line", line)
    container = (F.col("line.first") + F.floor((F.col("rank") - F.col("line.rank_0")) / F.col("line.each"))).cast("bigint")
    columns = ["id", "piece_no", "n_pieces", "size"]
    return placed.select(*columns, container.alias("container_id")).unionByName(pieces.where("size = 0").select(*columns, F.lit(0).cast("bigint").alias("container_id")))


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """`pack` for whole texts, sized by their tokens."""
    return pack(token_sizes(df, id_col, text_col, vocabulary), capacity)
