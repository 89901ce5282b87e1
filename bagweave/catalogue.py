"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagweave.functions import vectors as V
from bagweave.operators import choosers, learning, nested
from bagweave.operators import scores as S
from bagweave.operators import statistics as Q
from bagweave.plans import tree as T
from bagweave.session import read_table
from bagweave.sources import logs, tables

# scenes: bags and entities over the test tables

PROPERTIES = ("quantity", "price", "discount", "tax", "loc")


def orders_scene(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as bags, their lineitems as entities; the label is a finished order."""
    from pyspark.sql.window import Window

    bags = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("bag_id"), (F.col("o_orderstatus") == "F").alias("label"))
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    price = F.col("l_extendedprice")
    items = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bag_id"), number.cast("bigint").alias("entity_id"), F.col("l_quantity").alias("quantity"), price.alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.array(F.col("l_quantity"), price / 1000).alias("loc"))
    return bags, items


ORDERS = """
ob as (select o_orderkey as bag_id, o_orderstatus = 'F' as label from orders),
oe as (select l_orderkey as bag_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as entity_id,
  l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax, [l_quantity, l_extendedprice / 1000] as loc from lineitem),
b1 as (select b.bag_id, b.label, e.entity_id as v0 from ob b left join oe e on e.bag_id = b.bag_id),
b2 as (select b.bag_id, b.label, b.v0, e.entity_id as v1 from b1 b left join oe e on e.bag_id = b.bag_id and e.entity_id is distinct from b.v0),
b3 as (select b.bag_id, b.label, b.v0, b.v1, e.entity_id as v2 from b2 b left join oe e on e.bag_id = b.bag_id and e.entity_id is distinct from b.v0 and e.entity_id is distinct from b.v1)
"""


def bound(spark: SparkSession, d: str, depth: int, carry: tuple[str, ...] = ()) -> DataFrame:
    bags, entities = orders_scene(spark, d)
    rows = bags
    for i in range(depth):
        rows = T.bind(rows, T.candidates(entities, None, i, carry), i)
    return rows


def r6(c) -> F.Column:
    """Rounded; NaN as NULL and no negative zero, so that engines agree on the text of a value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), None).otherwise(F.round(c, 6) + 0.0)


def q6(sql: str) -> str:
    return f"case when isnan({sql}) then null else round({sql}, 6) + 0.0 end"


# the flagship tree: two variables, difference of quantity within 5 of 10

CENTER, WITHIN = 10.0, 5.0


def flagship() -> T.Root:
    split = T.Split(T.difference(T.property_of("quantity")), (0, 1), T.DistanceThreshold((CENTER,), WITHIN), T.Leaf(0.6), T.Leaf(0.4), T.Leaf(0.2))
    return T.numbered(T.Root(T.Var(T.Var(split))))


def flagship_leaves(spark: SparkSession, d: str) -> tuple[T.Root, DataFrame]:
    tree = flagship()
    return tree, T.propagate(tree, *orders_scene(spark, d))


ROUTED = (
    f"with {ORDERS}, routed as (select b.bag_id, b.label, b.v0, b.v1, case when x.quantity is null or y.quantity is null then 'err' "
    f"when abs(x.quantity - y.quantity - {CENTER}) <= {WITHIN} then 'yes' else 'no' end as branch "
    "from b2 b left join oe x on x.bag_id = b.bag_id and x.entity_id = b.v0 left join oe y on y.bag_id = b.bag_id and y.entity_id = b.v1), "
    "leafed as (select distinct case branch when 'yes' then 4 when 'no' then 5 else 6 end as leaf_id, bag_id, label from routed), "
    "lv as (select * from (values (4, 0.6, 0.0), (5, 0.4, 0.0), (6, 0.2, 0.0)) t(leaf_id, probability, strength)), "
    "best as (select l.leaf_id, bag_id, label from leafed l join lv using (leaf_id) qualify row_number() over (partition by bag_id order by probability desc, leaf_id) = 1), "
    "counted as (select lv.leaf_id, lv.probability, count(*) filter (where label) as pos, count(*) filter (where not label) as neg from lv left join best using (leaf_id) group by all) "
)


def split_3way(spark, d):
    bags, entities = orders_scene(spark, d)
    tree = flagship()
    split = next(n for n in T.walk(tree) if isinstance(n, T.Split))
    rows = T.with_value(bound(spark, d, 2, split.function.properties), entities, split.function, split.variables)
    return rows.select(T.route(F.col("value"), split.predicate).alias("branch"), "label").groupBy("branch", "label").agg(F.count("*").alias("n"))


def max_leaf_counts(spark, d):
    tree, leafed = flagship_leaves(spark, d)
    return S.max_leaf_counts(leafed, S.leaf_table(leafed, T.leaves(tree))).select("leaf_id", "probability", "pos", "neg")


def log_metric(spark, d):
    tree, leafed = flagship_leaves(spark, d)
    return S.log_metric(S.max_leaf_counts(leafed, S.leaf_table(leafed, T.leaves(tree)))).select(F.round("metric", 6).alias("metric"))


def max_leaf_bags(spark, d):
    tree, leafed = flagship_leaves(spark, d)
    return S.max_leaf_bags(leafed, S.leaf_table(leafed, T.leaves(tree)))


def leaf_probabilities(spark, d):
    tree, leafed = flagship_leaves(spark, d)
    fixed = S.greedy_probabilities(S.signatures(leafed), [x.id for x in T.leaves(tree)])
    return spark.createDataFrame([(k, p, s, n, m) for k, (p, s, n, m) in fixed.items()], "leaf_id int, probability double, strength double, pos bigint, neg bigint")


def value_of(spark, d, function: T.EntityFunction, variables, once=False):
    _, entities = orders_scene(spark, d)
    return T.with_value(bound(spark, d, max(variables) + 1, function.properties), entities, function, variables, once)


def elements(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    return df.select(*keys, *(r6(F.get("value", F.lit(i))).alias(f"x{i}") for i in range(n)))


def _joined(k: int) -> str:
    """SQL: the bindings of k variables with their entities a, b, c."""
    names = "abc"[:k]
    return f"b{k} t " + " ".join(f"left join oe {n} on {n}.bag_id = t.bag_id and {n}.entity_id = t.v{i}" for i, n in enumerate(names))


def order_points(spark, d):
    """One 1-D point for each lineitem: its quantity."""
    bags, entities = orders_scene(spark, d)
    return entities.join(bags, "bag_id").select("bag_id", "label", F.array("quantity").alias("point"))


SEED = 25.0


def distances(spark, d):
    return S.near_far(order_points(spark, d), F.array(F.lit(SEED)))


NEAR = f"with {ORDERS}, nf as (select e.bag_id, b.label, min(abs(quantity - {SEED})) as near, max(abs(quantity - {SEED})) as far from oe e join ob b using (bag_id) group by all) "
SWEEP = NEAR + """, edge as (select near as d, label::int as po, (not label)::int as no, 0 as pc, 0 as nc from nf union all select far, 0, 0, label::int, (not label)::int from nf),
folded as (select d as distance, sum(po) as po, sum(no) as no, sum(pc) as pc, sum(nc) as nc from edge group by d),
swept as (select distance, lead(distance) over (order by distance) as next, sum(pc) over w as y_pos, sum(nc) over w as y_neg, sum(po) over w - sum(pc) over w as m_pos, sum(no) over w - sum(nc) over w as m_neg,
  sum(po) over () - sum(po) over w as n_pos, sum(no) over () - sum(no) over w as n_neg from folded window w as (order by distance rows unbounded preceding))
"""
SCORED = SWEEP + """, hot as (select *, case when y_pos + m_pos + y_neg + m_neg > 0 then (y_pos + m_pos)::double / (y_pos + m_pos + y_neg + m_neg) else 0 end
  > case when n_pos + m_pos + n_neg + m_neg > 0 then (n_pos + m_pos)::double / (n_pos + m_pos + n_neg + m_neg) else 0 end as h from swept),
side as (select *, y_pos + case when h then m_pos else 0 end as yp, y_neg + case when h then m_neg else 0 end as yn, n_pos + case when h then 0 else m_pos end as np, n_neg + case when h then 0 else m_neg end as nn from hot),
scored as (select *, case when h then
  case when yp > 0 then yp * ln(yp::double / (yp + yn)) else 0 end + case when yn > 0 then yn * ln(yn::double / (yp + yn)) else 0 end
  + case when np > 0 then np * ln(np::double / (np + nn)) else 0 end + case when nn > 0 then nn * ln(nn::double / (np + nn)) else 0 end end as score,
  coalesce((distance + next) / 2, distance) as threshold from side)
"""


def best_threshold(spark, d):
    return S.best_threshold(distances(spark, d), F.lit(True)).select(F.round("score", 6).alias("score"), "threshold")


BEST = SCORED + ", top as (select score, threshold from scored where score is not null order by round(score, 9) desc, distance limit 1) "


def near_points(spark, d):
    dist = distances(spark, d)
    best = S.best_threshold(dist, F.lit(True)).select("threshold")
    joined = dist.join(F.broadcast(best))  # one row
    return S.near_points(joined, F.col("threshold"), F.lit(True)).select("bag_id", "label", "near", "agrees")


def event_points(spark, d):
    """Bags of a user's day with an error event as label, values / 100 as points."""
    e = read_table(spark, d, "events").where("value is not null")
    bag = (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("bag_id")
    e = e.select("event_id", bag, F.col("event_type").eqNullSafe("error").alias("is_error"), (F.col("value") / 100).alias("x"))
    labels = e.groupBy("bag_id").agg(F.max("is_error").alias("label"))
    return e.join(labels, "bag_id").select("bag_id", F.col("event_id").alias("entity_id"), "label", F.array("x").alias("point"))


EVENTS = "ev as (select user_id * 1000 + dayofyear(ts) as bag_id, coalesce(event_type = 'error', false) as is_error, value / 100 as x from events where value is not null), el as (select bag_id, bool_or(is_error) as label from ev group by 1), ep as (select bag_id, label, x from ev join el using (bag_id)) "


def diverse_density(spark, d):
    return Q.diverse_density(event_points(spark, d)).select("seed_bag", F.round(F.get("seed_point", F.lit(0)), 6).alias("seed"), F.round("score", 5).alias("score"))


def densest_point(spark, d):
    return Q.densest_point(Q.diverse_density(event_points(spark, d))).select("seed_bag", F.round(F.get("seed_point", F.lit(0)), 6).alias("seed"), F.round("score", 5).alias("score"))


DENSITY = f"with {EVENTS}, seed as (select distinct bag_id as seed_bag, x as s from ep where bag_id in (select distinct bag_id from ep where label order by bag_id limit 4)), near as (select seed_bag, s, bag_id, label, min((x - s) * (x - s)) as d from ep, seed group by all), scored as (select seed_bag, s, sum(case when label then d when 1 - exp(-d) > 0 then -ln(1 - exp(-d)) else 'inf'::double end) as score from near group by seed_bag, s) "


def kernel_density_2d(spark, d):
    points = lineitem_points(spark, d).select(F.array("x", "y").alias("point"))
    return Q.kernel_density(points, 2).select(*(F.round(F.get("cell", F.lit(i)), 5).alias(f"cell_{i}") for i in (0, 1)), F.round("density", 3).alias("density"))


def mahalanobis_min(spark, d):
    bags, entities = orders_scene(spark, d)
    points = entities.join(bags, "bag_id").select("bag_id", "label", F.col("loc").alias("point"))
    return Q.nearest_in_bags(points, [25.0, 38.0], [[0.02, -0.005], [-0.005, 0.01]]).select("bag_id", "label", r6("d2").alias("d2"), r6(F.get("point", F.lit(0))).alias("x"), r6(F.get("point", F.lit(1))).alias("y"))


def kernel_density_1d(spark, d):
    return Q.kernel_density(event_points(spark, d)).select(F.round(F.get("cell", F.lit(0)), 6).alias("cell"), F.round("density", 4).alias("density"))


def lineitem_points(spark, d):
    return read_table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


def gaussian_mle(spark, d):
    return Q.gaussian_mle(lineitem_points(spark, d), ["x", "y"]).select(*(F.round(F.col("mean")[i], 5).alias(f"m{i}") for i in (0, 1)), *(F.round(F.col("cov")[i][j], 4).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)))


def mahalanobis_2d(spark, d):
    p = V.mahalanobis_squared(F.array("l_quantity", F.col("l_extendedprice") / 1000), [25.0, 38.0], [[0.02, -0.005], [-0.005, 0.01]])
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(p).alias("d2"))


def vec_stats(how, dims=8):
    def run(spark, d):
        df = read_table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("e"))
        return Q.vector_aggregate(df, "e", dims, how).select(F.posexplode("value").alias("dim", "x")).select("dim", F.round("x", 6).alias("x"))

    return run


def user_events(spark, d):
    return read_table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")


def event_states(spark, d):
    """Events as a user's states: a click is a kick, an error starts a new session."""
    e = user_events(spark, d)
    return e.select("user_id", F.struct("ts", "event_id").alias("state_idx"), F.col("event_type").eqNullSafe("click").alias("kick"), F.col("event_type").eqNullSafe("error").alias("new_session"))


def lookahead_label(spark, d):
    return choosers.lookahead_labels(event_states(spark, d), "user_id", 3).select("user_id", F.col("state_idx.event_id").alias("event_id"), "label")


LOOKAHEAD = """with s as (select user_id, event_id, coalesce(event_type = 'click', false) as kick, coalesce(event_type = 'error', false) as ns, row_number() over (partition by user_id order by ts, event_id) as n from events),
t as (select *, max(n) over (partition by user_id) as last, min(case when kick then n end) over w as nk, min(case when ns then n end) over w as nx, lead(ns) over (partition by user_id order by n) as sn
  from s window w as (partition by user_id order by n rows between 1 following and unbounded following))
select user_id, event_id, coalesce(nx <= case when nk is null then last else greatest(nk, n + 3) end, false) as label from t where kick and last - n >= 3 and not coalesce(sn, false)"""


def kicks(spark, d):
    s = read_table(spark, d, "states").dropDuplicates(["game_id", "state_idx"])
    return choosers.hold_or_pass(s, "game_id")


def hold_pass_bags(spark, d):
    """The bags of holds and passes with the number of entities, and of pinned ones for each variable."""
    s = read_table(spark, d, "states").dropDuplicates(["game_id", "state_idx"])
    bags, entities, pins = choosers.hold_pass_bags(s, "game_id", strict=False)
    sizes = entities.groupBy("bag_id").agg(F.count("*").alias("n_entities"))
    fixed = pins.groupBy("bag_id").agg(F.count_if(F.col("depth") == 0).alias("n_kickers"), F.count_if(F.col("depth") == 1).alias("n_others"))
    whole = bags.join(sizes, "bag_id").join(fixed, "bag_id")
    return whole.select("bag_id.game_id", "bag_id.state_idx", "bag_id.kicker", "kind", "label", "n_entities", "n_kickers", "n_others")


KICKS = f"""with once as (select * from states qualify row_number() over (partition by game_id, state_idx order by received_at) = 1),
n as (select *, lead(ball) over w as nb, lead(players) over w as np from once window w as (partition by game_id order by state_idx)),
k as (select game_id, state_idx, ball, nb, np, players, unnest(list_filter(players, lambda p: p.team = 0 and p.kick_power is not null and not isnan(p.kick_power))) as k from n where nb is not null),
m as (select *, atan2(nb[2] - ball[2], nb[1] - ball[1]) as va,
  len(list_filter(np, lambda p: p.team = k.team and p.index = k.index and p.kick_power is not null and not isnan(p.kick_power))) > 0 as again from k),
t as (select *, list_transform(list_filter(players, lambda p: p.team = 0 and p.index <> k.index), lambda p:
  {{'turn': (atan2(p.location[2] - k.location[2], p.location[1] - k.location[1]) - va), 'index': p.index}}) as turns from m),
f as (select *, list_min(list_filter(list_transform(turns, lambda x: {{'turn': abs(case when x.turn > pi() then x.turn - 2 * pi() when x.turn < -pi() then x.turn + 2 * pi() else x.turn end), 'index': x.index}}), lambda x: x.turn < {choosers.PASS_ANGLE!r})) as best from t),
g as (select *, coalesce(not again and sqrt((nb[1] - ball[1]) ** 2 + (nb[2] - ball[2]) ** 2) > 0.6 and sqrt((nb[1] - k.location[1]) ** 2 + (nb[2] - k.location[2]) ** 2) > 0.6 and best is not null, false) as is_pass from f)
select game_id, state_idx, k.team as team, k.index as index, case when is_pass then best.index end as receiver, is_pass from g"""


HOLDS = f"""with kick as ({KICKS}),
once as (select * from states qualify row_number() over (partition by game_id, state_idx order by received_at) = 1),
s as (select game_id, state_idx, players, len(list_filter(players, lambda p: p.team = 0 and p.kick_power is not null and not isnan(p.kick_power))) > 0 as kick,
  coalesce(new_session, false) as ns, row_number() over (partition by game_id order by state_idx) as n from once),
t as (select *, max(n) over (partition by game_id) as last, min(case when kick then n end) over w as nk, min(case when ns then n end) over w as nx, lead(ns) over (partition by game_id order by n) as sn
  from s window w as (partition by game_id order by n rows between 1 following and unbounded following)),
l as (select *, coalesce(nx <= case when nk is null then last else greatest(nk, n + {choosers.AHEAD}) end, false) as label from t where kick and last - n >= {choosers.AHEAD} and not coalesce(sn, false))
select l.game_id, l.state_idx, k.index as kicker, case when k.is_pass then 'pass' else 'hold' end as kind, l.label, len(l.players) + 1 as n_entities,
  len(list_filter(l.players, lambda p: p.team = 0 and p.index = k.index)) as n_kickers,
  len(list_filter(l.players, lambda p: case when k.is_pass then p.team = 0 and p.index = k.receiver else p.team = 1 end)) as n_others
from l join kick k using (game_id, state_idx)"""


def train_valid_split(spark, d):
    bags, _ = orders_scene(spark, d)
    return learning.train_validation(bags).select("bag_id", "train")


def participants_of(entities: DataFrame) -> DataFrame:
    return entities.groupBy("bag_id").agg(F.min("entity_id").alias("entity_id")).select("bag_id", F.lit(0).alias("depth"), "entity_id")


def bind_participants(spark, d):
    bags, entities = orders_scene(spark, d)
    pins = participants_of(entities)
    rows = T.bind(bags, T.candidates(entities, pins, 0), 0)
    return T.bind(rows, T.candidates(entities, pins, 1), 1)


def learn_tree(spark, d):
    """A tree over the events scene: how it splits, as rows."""
    points = event_points(spark, d)
    entities = points.select("bag_id", "entity_id", F.get("point", F.lit(0)).alias("value"))
    config = learning.Config((T.valid(1), T.property_of("value")))
    tree = learning.learn(points.select("bag_id", "label").distinct(), entities, config)
    rows = [(n.id, type(n).__name__, getattr(n, "probability", None)) for n in T.walk(tree or config.initial)]
    return spark.createDataFrame(rows, "node_id int, kind string, probability double")


def bootstrap_pvalue(spark, d):
    tree, leafed = flagship_leaves(spark, d)
    counts = S.signatures(leafed)
    p = Q.bootstrap_p_value(learning.max_counts(tree, counts), [(sum(n for (_, x), n in counts.items() if not x), sum(n for (_, x), n in counts.items() if x), 0.5)])
    return spark.createDataFrame([(p,)], "p double")


def bags_json(spark, d):
    bags, entities = orders_scene(spark, d)
    items = entities.select("bag_id", "entity_id", F.lit("item").alias("type"), F.col("loc").alias("location"), F.lit(1).alias("depth"), F.lit(0.0).alias("passer"), F.lit(0.0).alias("receiver"))
    return tables.bags_to_json(bags, items)


def graph(spark, d):
    search = learning.best_first_search([0], lambda x: -abs(x - 37), lambda x: [x * 2, x + 1] if x < 100 else [], lambda x: x == 37)
    return spark.createDataFrame([(search,)], "found bigint")


def tables_of(name):
    return lambda spark, d: nested.nested_tables(read_table(spark, d, "graph_exports"), "record_id", "payload")[name]


def p2_found(spark, d):
    return nested.nested_items(read_table(spark, d, "graph_exports"), "record_id", "payload").select("record_id", "graph_no", "item_path").distinct()


def angles(spark, d):
    hour = F.hour("ts") + F.minute("ts") / 60
    return read_table(spark, d, "events").select("event_id", r6(V.wrap_radians(hour * (2 * math.pi / 24) * 3 - 10)).alias("wrapped"), r6(F.atan2(F.col("value"), hour + 1)).alias("angle"))


def reframe_3(spark, d):
    return elements(value_of(spark, d, T.reframed(T.property_of("loc", 2)), (0, 1, 2)), ["bag_id", "v0", "v1", "v2"], 2)


def _diff(i: int) -> str:
    return f"b.loc[{i}] - a.loc[{i}]", f"c.loc[{i}] - a.loc[{i}]"


(_T0, _R0), (_T1, _R1) = _diff(1), _diff(2)
_N = f"(({_T0}) * ({_T0}) + ({_T1}) * ({_T1}))"
REFRAME = f"""with {ORDERS} select t.bag_id, t.v0, t.v1, t.v2,
  case when {_N} = 0 or {_N} is null then null else round((({_R0}) * ({_T0}) + ({_R1}) * ({_T1})) / {_N}, 6) + 0.0 end as x0,
  case when {_N} = 0 or {_N} is null then null else round((({_T0}) * ({_R1}) - ({_T1}) * ({_R0})) / {_N}, 6) + 0.0 end as x1
  from {_joined(3)}"""


CATALOGUE = {
    "bag_left_join": (lambda s, d: bound(s, d, 0).join(orders_scene(s, d)[1], "bag_id", "left").select("bag_id", "label", "entity_id", "quantity"), f"with {ORDERS} select b.bag_id, b.label, e.entity_id, e.quantity from ob b left join oe e using (bag_id)"),
    "bind_1": (lambda s, d: bound(s, d, 1), f"with {ORDERS} select * from b1"),
    "bind_2": (lambda s, d: bound(s, d, 2), f"with {ORDERS} select * from b2"),
    "bind_3": (lambda s, d: bound(s, d, 3), f"with {ORDERS} select * from b3"),
    "bind_participants": (bind_participants, f"with {ORDERS}, pin as (select bag_id, min(entity_id) as v0 from oe group by 1), p1 as (select b.bag_id, b.label, p.v0 from ob b left join pin p using (bag_id)) select p.bag_id, p.label, p.v0, e.entity_id as v1 from p1 p left join oe e on e.bag_id = p.bag_id and e.entity_id is distinct from p.v0"),
    "valid_1": (lambda s, d: elements(value_of(s, d, T.valid(1), (0,)), ["bag_id", "v0"], 1), f"with {ORDERS} select bag_id, v0, case when v0 is null then 0.0 else 1.0 end::double as x0 from b1"),
    "valid_2": (lambda s, d: elements(value_of(s, d, T.valid(2), (0, 1)), ["bag_id", "v0", "v1"], 1), f"with {ORDERS} select bag_id, v0, v1, case when v0 is null or v1 is null then 0.0 else 1.0 end::double as x0 from b2"),
    "property_vec": (lambda s, d: elements(value_of(s, d, T.property_of("loc", 2), (0,)), ["bag_id", "v0"], 2), f"with {ORDERS} select t.bag_id, v0, round(a.loc[1], 6) + 0.0 as x0, round(a.loc[2], 6) + 0.0 as x1 from {_joined(1)}"),
    "difference": (lambda s, d: elements(value_of(s, d, T.difference(T.property_of("loc", 2)), (0, 1)), ["bag_id", "v0", "v1"], 2), f"with {ORDERS} select t.bag_id, v0, v1, round(a.loc[1] - b.loc[1], 6) + 0.0 as x0, round(a.loc[2] - b.loc[2], 6) + 0.0 as x1 from {_joined(2)}"),
    "distance": (lambda s, d: elements(value_of(s, d, T.distance(T.property_of("loc", 2)), (0, 1)), ["bag_id", "v0", "v1"], 1), f"with {ORDERS} select t.bag_id, v0, v1, round(list_distance(a.loc, b.loc), 6) + 0.0 as x0 from {_joined(2)}"),
    "dedup_args": (lambda s, d: elements(value_of(s, d, T.distance(T.property_of("loc", 2)), (0, 1), True), ["bag_id", "v0", "v1"], 1), f"with {ORDERS} select t.bag_id, v0, v1, round(list_distance(a.loc, b.loc), 6) + 0.0 as x0 from {_joined(2)}"),
    "reframe_2d": (reframe_3, REFRAME),
    "wrap_radians": (angles, "with h as (select event_id, value, hour(ts) + minute(ts) / 60.0::double as h from events), w as (select *, (h * (2 * pi() / 24) * 3 - 10) % (2 * pi()) as t from h) select event_id, " + q6("case when t > pi() then t - 2 * pi() when t < -pi() then t + 2 * pi() else t end") + " as wrapped, " + q6("atan2(value, h + 1)") + " as angle from w"),
    "split_3way": (split_3way, ROUTED + "select branch, label, count(*) as n from routed group by all"),
    "leaf_groups": (lambda s, d: flagship_leaves(s, d)[1], ROUTED + "select * from leafed"),
    "max_leaf_counts": (max_leaf_counts, ROUTED + "select leaf_id, probability::double as probability, pos, neg from counted"),
    "max_leaf_bags": (max_leaf_bags, ROUTED + "select * from best"),
    "log_metric": (log_metric, ROUTED + "select round(sum(case when pos > 0 then pos * ln(probability) else 0 end + case when neg > 0 then neg * ln(1 - probability) else 0 end), 6) as metric from counted"),
    "leaf_probabilities": (leaf_probabilities, None),
    "near_far": (lambda s, d: distances(s, d).select("bag_id", "label", "near", "far"), NEAR + "select * from nf"),
    "threshold_sweep": (lambda s, d: S.scored(S.sweep(distances(s, d)), F.lit(True)).select("distance", "y_pos", "y_neg", "m_pos", "m_neg", "n_pos", "n_neg", "threshold", F.round("score", 6).alias("score")), SCORED + "select distance, y_pos::bigint as y_pos, y_neg::bigint as y_neg, m_pos::bigint as m_pos, m_neg::bigint as m_neg, n_pos::bigint as n_pos, n_neg::bigint as n_neg, threshold, round(score, 6) as score from scored"),
    "best_threshold": (best_threshold, BEST + "select round(score, 6) as score, threshold from top"),
    "near_points": (near_points, BEST + "select bag_id, label, near, label as agrees from nf, top where near <= threshold"),
    "diverse_density": (diverse_density, f"with {EVENTS}, seed as (select distinct bag_id as seed_bag, x as s from ep where bag_id in (select distinct bag_id from ep where label order by bag_id limit 4)), near as (select seed_bag, s, bag_id, label, min((x - s) * (x - s)) as d from ep, seed group by all) select seed_bag, round(s, 6) as seed, round(sum(case when label then d when 1 - exp(-d) > 0 then -ln(1 - exp(-d)) else 'inf'::double end), 5) as score from near group by seed_bag, s"),
    "kernel_density_1d": (kernel_density_1d, f"with {EVENTS}, lim as (select min(x) as lo, max(x) as hi, (max(x) - min(x)) / 31 as h from ep), grid as (select lo + h * i as cell, h from lim, range(31) t(i)) select round(cell, 6) as cell, round(coalesce(sum(exp(-0.5 * (x - cell) * (x - cell) / h) / sqrt(2 * pi() * h)), 0), 4) as density from grid left join ep on (x - cell) * (x - cell) < 16 * h group by cell"),
    **{f"vec_{how}": (vec_stats(how), f"select i - 1 as dim, round({fn}(embedding[i]::double), 6) as x from (select embedding, unnest(range(1, 9)) as i from embeddings) group by i") for how, fn in (("min", "min"), ("max", "max"), ("mean", "avg"))},
    **{f"vec_{how}_all": (vec_stats(how, 64), f"select i - 1 as dim, round({fn}(embedding[i]::double), 6) as x from (select embedding, unnest(range(1, 65)) as i from embeddings) group by i") for how, fn in (("min", "min"), ("max", "max"), ("mean", "avg"))},
    "variance": (lambda s, d: Q.variance(lineitem_points(s, d), "x").select(F.round("variance", 4).alias("variance")), "select round(var_samp(l_quantity), 4) as variance from lineitem"),
    "covariance": (lambda s, d: Q.covariance(lineitem_points(s, d), "x", "y").select(F.round("covariance", 4).alias("covariance")), "select round(covar_samp(l_quantity, l_extendedprice / 1000), 4) as covariance from lineitem"),
    "gaussian_mle": (gaussian_mle, "with p as (select l_quantity as x, l_extendedprice / 1000 as y from lineitem) select round(avg(x), 5) as m0, round(avg(y), 5) as m1, round(var_samp(x), 4) as c00, round(covar_samp(x, y), 4) as c01, round(covar_samp(x, y), 4) as c10, round(var_samp(y), 4) as c11 from p"),
    "mahalanobis_2d": (mahalanobis_2d, "with p as (select *, l_quantity - 25 as a, l_extendedprice / 1000 - 38 as b from lineitem) select l_orderkey, l_linenumber, l_partkey, round(0.02 * a * a - 0.01 * a * b + 0.01 * b * b, 6) + 0.0 as d2 from p"),
    "range_match": (lambda s, d: Q.range_match(read_table(s, d, "embeddings"), "embedding", [0.0] * 64, 1.0000001).select("vec_id"), "select vec_id from embeddings where list_distance(embedding::double[64], list_resize([]::double[], 64, 0.0)::double[64]) <= 1.0000001".replace("::double[64]", "::double[]")),
    "train_valid_split": (train_valid_split, f"with {ORDERS}, k as (select bag_id, row_number() over (order by md5('0:' || bag_id::varchar)) as n, count(*) over () as c from ob) select bag_id, n <= floor(c * (2 / 3.0::double)) as train from k"),
    "all_bags_false": (lambda s, d: choosers.all_bags_false(user_events(s, d), "user_id"), "select distinct user_id as bag_id, false as label from events"),
    "replay_last_value": (lambda s, d: logs.last_values(user_events(s, d), "user_id", ["ts", "event_id"], ["value"]).select("event_id", "last_value"), "select event_id, last_value(value ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_value from events"),
    "session_id": (lambda s, d: logs.session_ids(user_events(s, d).withColumn("start", F.col("event_type").eqNullSafe("error")), "user_id", ["ts", "event_id"], "start").select("event_id", "session_id"), "select event_id, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session_id from events"),
    "lookahead_label": (lookahead_label, LOOKAHEAD),
    "hold_or_pass": (kicks, KICKS),
    "hold_pass_bags": (hold_pass_bags, HOLDS),
    "densest_point": (densest_point, DENSITY + "select seed_bag, round(s, 6) as seed, round(score, 5) as score from scored order by scored.score, seed_bag, s limit 1"),
    "kernel_density_2d": (kernel_density_2d, "with p as (select l_quantity::double as x, l_extendedprice / 1000 as y from lineitem), lim as (select min(x) as lx, (max(x) - min(x)) / 31 as hx, min(y) as ly, (max(y) - min(y)) / 31 as hy, least((max(x) - min(x)), (max(y) - min(y))) / 31 as h from p), grid as (select lx + hx * i as gx, ly + hy * j as gy, h from lim, range(31) a(i), range(31) b(j)), near as (select gx, gy, h, (x - gx) * (x - gx) + (y - gy) * (y - gy) as d from grid left join p on (x - gx) * (x - gx) + (y - gy) * (y - gy) < 16 * h) select round(gx, 5) as cell_0, round(gy, 5) as cell_1, round(coalesce(sum(exp(-0.5 * d / (h * h)) / (2 * pi() * h)), 0), 3) as density from near group by gx, gy"),
    "mahalanobis_min": (mahalanobis_min, f"with {ORDERS}, p as (select oe.bag_id, label, loc[1] as x, loc[2] as y, 0.02 * (loc[1] - 25) * (loc[1] - 25) - 0.01 * (loc[1] - 25) * (loc[2] - 38) + 0.01 * (loc[2] - 38) * (loc[2] - 38) as d2 from oe join ob using (bag_id)) select bag_id, label, round(d2, 6) + 0.0 as d2, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y from p qualify row_number() over (partition by bag_id order by d2, x, y) = 1"),
    "permutations_4_2": (lambda s, d: s.createDataFrame(list(V.permutations(4, 2)), "a int, b int"), "select a::int as a, b::int as b from range(4) x(a), range(4) y(b) where a <> b"),
    "bags_json": (bags_json, None),
    "tree_json": (lambda s, d: s.createDataFrame([(T.to_json(flagship()),)], "tree string"), None),
    "bootstrap_pvalue": (bootstrap_pvalue, None),
    "binomial_sample": (lambda s, d: Q.sample(s.range(1000), "binomial", (1000, 0.3)), None),
    "multinomial_sample": (lambda s, d: s.createDataFrame([tuple(map(int, r)) for r in Q.multinomial(1000, (0.2, 0.1, 0.4, 0.3), 100)], "a int, b int, c int, d int"), None),
    "synthetic_bags": (lambda s, d: learning.synthetic_bags(s)[1], None),
    "learn_tree": (learn_tree, None),
    "best_first_search": (graph, None),
    "p2_found": (p2_found, None),
    **{f"p2_{name}": (tables_of(name), None) for name in ("roots", "nodes", "edges", "graphs", "items")},
}


def queries() -> dict:
    return {name: run for name, (run, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
