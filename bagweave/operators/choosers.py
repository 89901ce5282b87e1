"""Choosers: state sequences to labelled bags."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagweave.functions import vectors as V

STILL, GROUND, GROUND_STEP = 0.01, 0.0, 0.01
AHEAD = 8
PASS_SPEED, PASS_DISTANCE, PASS_ANGLE = 0.6, 0.6, math.pi / 10


def live_items(items: DataFrame) -> DataFrame:
    """Items that are alive and not below the table."""
    return items.where(F.col("alive") & (F.get("location", F.lit(1)) >= GROUND))


def grasped_items(items: DataFrame) -> DataFrame:
    return items.where("grasped")


def _upright(orientation):
    """Orientations are half turns from -1 to 1; at the bounds themselves an item counts as lying on its side."""
    return (orientation < -0.75) | ((orientation > -0.25) & (orientation < 0.25)) | (orientation > 0.75)


def on_ground(extent, location, orientation):
    """Is the half-extent that points down equal to the height?"""
    return F.abs(F.get(extent, F.when(_upright(orientation), 1).otherwise(0)) - F.get(location, F.lit(1))) < GROUND_STEP


def all_bags_false(states: DataFrame, key: str) -> DataFrame:
    """Every state as a negative bag."""
    return states.select(F.col(key).alias("bag_id"), F.lit(False).alias("label")).distinct()


def not_moving(items: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(bags, participants): a bag for each live item of a state without a grasped one, the item pinned to variable 0;
    true if it is slower than STILL."""
    free = live_items(items).join(grasped_items(items).select(key).distinct(), key, "left_anti")
    bag = F.xxhash64(key, "id").alias("bag_id")
    bags = free.select(bag, F.col(key).alias("scene_id"), (V.norm(F.col("velocity")) < STILL).alias("label"))
    return bags, free.select(bag, F.lit(0).alias("depth"), F.col("id").alias("entity_id"))


def drop_episodes(states: pd.DataFrame) -> list[tuple[int, int, bool]]:
    """(state_idx of the drop, of the rest, did it land on another item?) of one log's states in order.

    states: state_idx, cleared, items. The state after grasping in which nothing is grasped any more, and the table not
    cleared, is the drop. From the state after it on, the episode ends when the table is cleared (without a label), when
    the item is gone (it fell off, which counts as true), or when it rests: true unless it rests on the ground. Grasps
    in between are ignored.
    """
    out, held, grasping, waiting = [], None, False, None
    for row in states.sort_values("state_idx").itertuples():
        items = {x["id"]: x for x in row.items}
        if waiting is None:
            grasped = next((i for i, x in items.items() if x["grasped"]), None)
            if grasped is not None:
                held = grasped
            elif grasping and not row.cleared:
                waiting = row.state_idx
            grasping = grasped is not None
            continue
        item, label = items.get(held), None
        if not row.cleared:
            if item is not None and not math.hypot(*item["velocity"]) < STILL:
                continue
            label = item is None or not abs(item["extent"][int(_upright(np.float64(item["orientation"])))] - item["location"][1]) < GROUND_STEP
        if label is not None:
            out.append((waiting, row.state_idx, bool(label)))
        waiting = None
    return out


def choose_drops(states: DataFrame, by: str) -> DataFrame:
    """(…by, drop_idx, rest_idx, label) of every log; a log's states are replayed in one task, as they depend on order."""
    schema = f"{by} {states.schema[by].dataType.simpleString()}, drop_idx bigint, rest_idx bigint, label boolean"

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *e) for e in drop_episodes(part)], columns=[by, "drop_idx", "rest_idx", "label"])

    return states.groupBy(by).applyInPandas(run, schema)


def drop_bags(states: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(bags, entities): a bag for each drop with its label, and the live items of the state of release.

    bag_id is a struct of the log and the index of that state. states: state_idx, cleared, items.
    """
    bags = choose_drops(states, by).withColumn("bag_id", F.struct(by, F.col("drop_idx").alias("state_idx")))
    there = states.select(by, F.col("state_idx").alias("drop_idx"), F.explode("items").alias("item"))
    placed = bags.select("bag_id", by, "drop_idx").join(there, [by, "drop_idx"]).select("bag_id", F.col("item.id").alias("entity_id"), "item.*").drop("id")
    return bags.select("bag_id", "rest_idx", "label"), live_items(placed)


def lookahead_labels(states: DataFrame, by: str, ahead: int = AHEAD) -> DataFrame:
    """Kick states with their failure label: states of `by`, in order of state_idx, with `kick` and `new_session`.

    A state counts if it has a kick, at least `ahead` later states and no new session next. With b the later of the
    next kick and `ahead` states on (no bound without a later kick), it fails if a new session comes up to b.
    """
    order = Window.partitionBy(by).orderBy("state_idx")
    # backwards, so that what comes later is a running minimum and not a frame of its own for each state
    later = Window.partitionBy(by).orderBy(F.desc("state_idx")).rowsBetween(Window.unboundedPreceding, -1)
    place = states.withColumn("n", F.row_number().over(order))
    ends = place.select("*", F.max("n").over(Window.partitionBy(by)).alias("last"), F.min(F.when(F.col("kick"), F.col("n"))).over(later).alias("next_kick"), F.min(F.when(F.col("new_session"), F.col("n"))).over(later).alias("next_session"), F.lead("new_session").over(order).alias("session_next"))
    used = ends.where(F.col("kick") & (F.col("last") - F.col("n") >= ahead) & ~F.coalesce("session_next", F.lit(False)))
    bound = F.when(F.col("next_kick").isNull(), F.col("last")).otherwise(F.greatest("next_kick", F.col("n") + ahead))
    return used.select(by, "state_idx", F.coalesce(F.col("next_session") <= bound, F.lit(False)).alias("label"))


def hold_or_pass(states: DataFrame, by: str) -> DataFrame:
    """(…by, state_idx, team, index, receiver, is_pass) of each kick by team 0, from the next state's ball and players.

    states: one row a state with `ball` and `players`. It is a pass if the kicker doesn't kick again next, the ball is
    fast and far enough, and a team-mate is in the ball's direction; the one with the smallest angle receives it.
    """
    order = Window.partitionBy(by).orderBy("state_idx")
    pairs = states.select(by, "state_idx", "ball", "players", F.lead("ball").over(order).alias("next_ball"), F.lead("players").over(order).alias("next_players")).where("next_ball is not null")
    kicker = pairs.select("*", F.explode(F.filter("players", lambda p: (p["team"] == 0) & p["kick_power"].isNotNull() & ~F.isnan(p["kick_power"]))).alias("k"))
    again = F.exists("next_players", lambda p: (p["team"] == F.col("k.team")) & (p["index"] == F.col("k.index")) & p["kick_power"].isNotNull() & ~F.isnan(p["kick_power"]))
    v = V.subtract(F.col("next_ball"), F.col("ball"))
    far = V.distance(F.col("next_ball"), F.col("k.location"))
    mates = F.filter("players", lambda p: (p["team"] == 0) & (p["index"] != F.col("k.index")))
    turns = F.transform(mates, lambda p: F.struct(F.abs(V.wrap_radians(V.angle_of(V.subtract(p["location"], F.col("k.location"))) - V.angle_of(F.col("v")))).alias("turn"), p["index"].alias("index")))
    best = kicker.withColumn("v", v).withColumn("best", F.array_min(F.filter(turns, lambda t: t["turn"] < PASS_ANGLE)))
    passed = ~again & (V.norm(F.col("v")) > PASS_SPEED) & (far > PASS_DISTANCE) & F.col("best").isNotNull()
    return best.select(by, "state_idx", F.col("k.team").alias("team"), F.col("k.index").alias("index"), F.when(passed, F.col("best.index")).alias("receiver"), F.coalesce(passed, F.lit(False)).alias("is_pass"))


def hold_pass_bags(states: DataFrame, by: str, ahead: int = AHEAD, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bags, entities, participants) of the holds and passes of the keepers (team 0).

    bags: bag_id (a struct of `by` and state_idx), kind (hold or pass), label: did the keepers lose the ball too soon?
    entities: the ball (entity_id 0) and the players (their place from 1) of the state. participants: variable 0 is the
    kicker, variable 1 the receiver of a pass, or any taker (team 1) during a hold.

    states: one row a state with ball, players, new_session. Several kickers in one state are an error; with
    strict=False each of them makes a bag of its own.
    """
    kicks = lambda p: (p["team"] == 0) & p["kick_power"].isNotNull() & ~F.isnan(p["kick_power"])
    n = F.size(F.filter("players", kicks))
    kick = F.when((n > 1) & F.lit(strict), F.raise_error(F.concat(F.lit("several kickers in state "), F.col("state_idx").cast("string"))).cast("boolean")).otherwise(F.coalesce(n > 0, F.lit(False)))
    labels = lookahead_labels(states.select(by, "state_idx", kick.alias("kick"), F.coalesce("new_session", F.lit(False)).alias("new_session")), by, ahead)
    made = hold_or_pass(states, by).join(labels, [by, "state_idx"])
    bag_id = F.struct(by, "state_idx", F.col("index").alias("kicker"))
    made = made.join(states.select(by, "state_idx", "ball", "players"), [by, "state_idx"]).withColumn("bag_id", bag_id)
    bags = made.select("bag_id", F.when(F.col("is_pass"), "pass").otherwise("hold").alias("kind"), "label")
    players = made.select("bag_id", "index", "receiver", "is_pass", F.posexplode("players").alias("place", "p"))
    entity = F.col("place") + 1
    whole = players.select("bag_id", entity.alias("entity_id"), F.lit("player").alias("type"), "p.team", "p.index", "p.location", "p.orientation")
    ball = made.select("bag_id", F.lit(0).alias("entity_id"), F.lit("ball").alias("type"), F.lit(None).cast("int").alias("team"), F.lit(None).cast("bigint").alias("index"), F.col("ball").alias("location"), F.lit(None).cast("double").alias("orientation"))
    is_kicker = (F.col("p.team") == 0) & (F.col("p.index") == F.col("index"))
    second = F.when(F.col("is_pass"), (F.col("p.team") == 0) & (F.col("p.index") == F.col("receiver"))).otherwise(F.col("p.team") == 1)
    pins = players.select("bag_id", F.when(is_kicker, 0).when(second, 1).alias("depth"), entity.alias("entity_id")).where("depth is not null")
    return bags, ball.unionByName(whole), pins
