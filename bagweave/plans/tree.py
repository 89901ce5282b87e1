"""Relational probability trees: immutable nodes, entity functions, predicates, and the compiler to one Spark plan.

A tree is a query plan. A variable node extends every binding by each entity of its bag that isn't bound yet, or by a
dummy (NULL) if there is none. A split node computes a function of bound entities and routes each binding to its yes,
no or error branch. A leaf collects the bindings that reach it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagweave.functions import vectors as V

# entity functions


@dataclass(frozen=True)
class EntityFunction:
    """A function of the entities of some variables; `column` gets one struct column of properties for each."""

    name: str
    arity: int
    column: Callable[[Sequence[Column]], Column] = field(compare=False)
    properties: tuple[str, ...] = ()


def property_of(name: str, count: int = 1) -> EntityFunction:
    """The property of one entity, as a vector of `count` values; NaN for a dummy."""
    read = (lambda e: e[0][name]) if count > 1 else (lambda e: F.array(e[0][name].cast("double")))
    return EntityFunction(name, 1, lambda e: F.when(e[0].isNull(), F.array_repeat(V.nan(), count)).otherwise(read(e)), (name,))


def valid(arity: int) -> EntityFunction:
    """1 if all entities are bound, else 0; never NaN."""
    return EntityFunction(f"Valid{arity}", arity, lambda e: F.array(F.when(sum((x.isNull().cast("int") for x in e[1:]), e[0].isNull().cast("int")) == 0, 1.0).otherwise(0.0)))


def difference(base: EntityFunction) -> EntityFunction:
    return EntityFunction("Difference" + base.name, 2, lambda e: V.subtract(base.column([e[0]]), base.column([e[1]])), base.properties)


def distance(base: EntityFunction) -> EntityFunction:
    """Full Euclidean length of the difference."""
    return EntityFunction("Distance" + base.name, 2, lambda e: F.array(V.distance(base.column([e[0]]), base.column([e[1]]))), base.properties)


def reframed(base: EntityFunction, dims: int = 2) -> EntityFunction:
    """The third entity in the frame of the first (origin) and the second (unit on the first axis)."""
    return EntityFunction("Reframe" + base.name, 3, lambda e: V.reframe(*(base.column([x]) for x in e), dims=dims), base.properties)


def default_functions(properties: dict[str, int], reframe_of: Sequence[str] = ()) -> list[EntityFunction]:
    """Validity of one and two entities, then each property, its distance and difference, and frames where asked."""
    out = [valid(1), valid(2)]
    for name, count in properties.items():
        base = property_of(name, count)
        out += [base, distance(base), difference(base)]
        if name in reframe_of:
            out.append(reframed(base, count))
    return out


# predicates


@dataclass(frozen=True)
class DistanceThreshold:
    """True where the distance to the centre is at most the threshold."""

    center: tuple[float, ...]
    threshold: float

    def column(self, value: Column) -> Column:
        return V.distance(value, F.array(*(F.lit(float(c)) for c in self.center))) <= F.lit(float(self.threshold))

    def to_dict(self) -> dict:
        return {"name": "DistanceThreshold", "function": {"name": "Mahalanobis", "center": list(self.center)}, "threshold": self.threshold}


@dataclass(frozen=True)
class Equals:
    value: float

    def column(self, value: Column) -> Column:
        return F.get(value, F.lit(0)) == F.lit(float(self.value))

    def to_dict(self) -> dict:
        return {"name": "Equals", "value": self.value}


# nodes


@dataclass(frozen=True)
class Leaf:
    probability: float = 0.5
    strength: float = 0.0
    id: int = -1

    def kids(self) -> tuple:
        return ()


@dataclass(frozen=True)
class Var:
    kid: object
    id: int = -1

    def kids(self) -> tuple:
        return (self.kid,)


@dataclass(frozen=True)
class Split:
    function: EntityFunction | None
    variables: tuple[int, ...]
    predicate: object | None
    yes: object = None
    no: object = None
    err: object = None
    id: int = -1

    def kids(self) -> tuple:
        return tuple(k for k in (self.yes, self.no, self.err) if k is not None)


@dataclass(frozen=True)
class Root:
    kid: object
    id: int = 0

    def kids(self) -> tuple:
        return (self.kid,)


def with_kids(node, kids: Sequence):
    if isinstance(node, (Root, Var)):
        return replace(node, kid=kids[0])
    if isinstance(node, Split):
        rest = iter(kids)
        return replace(node, **{k: next(rest) if getattr(node, k) is not None else None for k in ("yes", "no", "err")})
    return node


def numbered(root: Root) -> Root:
    """The tree with ids in pre-order, the root 0."""
    at = iter(range(1 << 30))

    def visit(node):
        own = next(at)
        return replace(with_kids(node, [visit(k) for k in node.kids()]), id=own)

    return visit(root)


def walk(node):
    yield node
    for kid in node.kids():
        yield from walk(kid)


def find(root, node_id: int):
    return next((n for n in walk(root) if n.id == node_id), None)


def leaves(root) -> list[Leaf]:
    return [n for n in walk(root) if isinstance(n, Leaf)]


def replaced(root, node_id: int, new):
    """The tree with another node in place of one (everything else is shared)."""
    return new if root.id == node_id else with_kids(root, [replaced(k, node_id, new) for k in root.kids()])


def depth_of(root, node_id: int) -> int:
    """Number of variables bound above a node; -1 if it isn't there."""

    def visit(node, depth):
        if node.id == node_id:
            return depth
        return max((visit(k, depth + isinstance(node, Var)) for k in node.kids()), default=-1)

    return visit(root, 0)


def to_dict(node) -> dict:
    out = {"id": node.id, "type": type(node).__name__}
    if isinstance(node, Leaf):
        out |= {"probability": node.probability, "strength": node.strength}
    if isinstance(node, Split):
        if node.function is not None:
            out |= {"function": node.function.name, "vars": list(node.variables)}
        if node.predicate is not None:
            out["predicate"] = node.predicate.to_dict()
    if node.kids():
        out["kids"] = [to_dict(k) for k in node.kids()]
    return out


def to_json(root, indent: int | None = 2) -> str:
    return json.dumps(to_dict(root), indent=indent)


# execution


def candidates(entities: DataFrame, participants: DataFrame | None, depth: int, carry: Sequence[str] = ()) -> DataFrame:
    """(bag_id, entity[, arg]) that a variable at `depth` may take: the bag's participants at that depth, else its
    entities. arg: the properties to carry along, so that functions of the variable need no join of their own."""
    properties = [F.struct(*carry).alias("arg")] if carry else []
    own = entities.select("bag_id", F.col("entity_id").alias("entity"), *properties)
    if participants is None:
        return own
    pinned = participants.where(F.col("depth") == depth).select("bag_id", F.col("entity_id").alias("entity"))
    free = own.join(pinned.select("bag_id").distinct(), "bag_id", "left_anti")
    if carry:
        pinned = pinned.join(own, ["bag_id", "entity"], "left")
    return free.unionByName(pinned)


def bind(bindings: DataFrame, cand: DataFrame, depth: int) -> DataFrame:
    """Extends bindings (bag_id, label, v0 .. v{depth-1}) by v{depth}, and by a{depth} with what the candidates carry.

    A left join on the bag with null-safe inequality to what is bound: without a candidate the new variable is NULL,
    and later variables may still bind entities. Every variable is bound on the bag, so the bindings keep their
    partitioning, and the entities are shuffled once for all variables.
    """
    right = cand.withColumnRenamed("bag_id", "cand_bag")
    free = F.col("bag_id") == F.col("cand_bag")
    for i in range(depth):
        free = free & ~F.col("entity").eqNullSafe(F.col(f"v{i}"))
    joined = bindings.join(right, free, "left").drop("cand_bag").withColumnRenamed("entity", f"v{depth}")
    return joined.withColumnRenamed("arg", f"a{depth}")


def packed(bags: DataFrame, entities: DataFrame | None, participants: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """bags with the entities of each in a column of its row: `ents` (entity, arg) and `pins` (depth, entity, arg).

    A bag then is bound where its row is read, and its bindings follow each other; `propagate` needs no join or shuffle.
    entities: None if the bags have none.
    """
    if entities is None:
        return bags.withColumns({"ents": F.array().cast("array<struct<entity:bigint,arg:struct<entity_id:bigint>>>"), "pins": F.lit(None).cast("array<struct<depth:int,entity:bigint,arg:struct<entity_id:bigint>>>")})
    own = candidates(entities, None, 0, carry or ("entity_id",))
    out = bags.join(own.groupBy("bag_id").agg(F.collect_list(F.struct("entity", "arg")).alias("ents")), "bag_id", "left")
    if participants is None:
        return out.withColumn("pins", F.transform(F.slice("ents", 1, 0), lambda e: F.struct(F.lit(0).alias("depth"), e["entity"].alias("entity"), e["arg"].alias("arg"))))
    pinned = participants.select("bag_id", "depth", F.col("entity_id").alias("entity")).join(own, ["bag_id", "entity"], "left")
    return out.join(pinned.groupBy("bag_id").agg(F.collect_list(F.struct("depth", "entity", "arg")).alias("pins")), "bag_id", "left")


def _bind_packed(rows: DataFrame, depth: int, node: int | None = None) -> DataFrame:
    """`bind` for packed bags; with a node, only for rows that are there."""
    pins = F.filter("pins", lambda e: e["depth"] == depth)
    cand = F.when(F.size(pins) > 0, F.transform(pins, lambda e: F.struct(e["entity"].alias("entity"), e["arg"].alias("arg")))).otherwise(F.col("ents"))
    if depth:

        def free(e: Column) -> Column:
            out = ~e["entity"].eqNullSafe(F.col("v0"))
            for i in range(1, depth):
                out = out & ~e["entity"].eqNullSafe(F.col(f"v{i}"))
            return out

        cand = F.filter(cand, free)
    here = F.lit(True) if node is None else F.col("leaf_id") == node
    rows = rows.withColumn("bound", F.explode_outer(F.when(here, cand)))
    new = {f"v{depth}": F.col("bound.entity"), f"a{depth}": F.col("bound.arg")}
    # a variable of this depth in another branch keeps what it is bound to
    return rows.withColumns({c: F.when(here, x).otherwise(F.col(c)) if c in rows.columns else x for c, x in new.items()}).drop("bound")


def _propagate_packed(root: Root, bags: DataFrame, below: int | None = None) -> DataFrame:
    """Packed bags with leaf_id, v0 .., a0 ..: a row for each binding. All branches are one chain of narrow steps, so a
    bag's rows are never parted. below: only rows that reach this leaf."""
    way = {n.id for n in walk(root) if below is None or find(n, below) is not None}
    rows = bags.withColumn("leaf_id", F.lit(root.kid.id))

    def visit(node, rows: DataFrame, depth: int) -> DataFrame:
        at = F.col("leaf_id")
        if isinstance(node, Leaf):
            return rows
        if isinstance(node, Var):
            rows = _bind_packed(rows, depth, node.id).withColumn("leaf_id", F.when(at == node.id, F.lit(node.kid.id)).otherwise(at))
            return visit(node.kid, rows, depth + 1)
        kids = {b: getattr(node, b) for b in ("yes", "no", "err") if getattr(node, b) is not None}
        branch = F.lit("err")
        if node.function is not None and node.predicate is not None:
            branch = route(node.function.column(_arguments(node.function, node.variables)), node.predicate)
        goal = F.lit(None).cast("int")
        for b, kid in kids.items():
            if kid.id in way:
                goal = F.when(F.col("branch") == b, F.lit(kid.id)).otherwise(goal)
        rows = rows.withColumn("branch", F.when(at == node.id, branch)).withColumn("leaf_id", F.when(at == node.id, goal).otherwise(at)).drop("branch")
        if sum(kid.id in way for kid in kids.values()) < 3:
            rows = rows.where("leaf_id is not null")
        for kid in kids.values():
            if kid.id in way:
                rows = visit(kid, rows, depth)
        return rows

    return visit(root.kid, rows, 0)


def _arguments(function: EntityFunction, variables: Sequence[int]) -> list[Column]:
    if function.properties:
        return [F.col(f"a{i}") for i in variables]
    return [F.when(F.col(f"v{i}").isNotNull(), F.struct(F.col(f"v{i}").alias("entity_id"))) for i in variables]


def packed_values(root: Root, leaf_id: int, new: int, function: EntityFunction, index: Sequence[int], bags: DataFrame) -> DataFrame:
    """Packed bags, a row for each binding of a leaf and `new` further variables: value of the function."""
    rows, depth = _propagate_packed(root, bags, leaf_id), depth_of(root, leaf_id)
    for d in range(depth, depth + new):
        rows = _bind_packed(rows, d)
    return rows.withColumn("value", function.column(_arguments(function, index)))


def needed_properties(root) -> list[str]:
    """The properties that the functions of a tree read."""
    return list(dict.fromkeys(p for n in walk(root) if isinstance(n, Split) and n.function is not None for p in n.function.properties))


def with_value(bindings: DataFrame, entities: DataFrame, function: EntityFunction, variables: Sequence[int], once: bool = False) -> DataFrame:
    """Adds `value`, the function of the given variables. Properties that the bindings don't carry are joined to them.

    once: evaluate each distinct tuple of arguments of a bag once and join the value back (for costly functions deep in
    a tree, where the same arguments occur with many other bindings).
    """
    names = [f"v{i}" for i in variables]
    if not function.properties:
        stand_in = [F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("entity_id"))) for n in names]
        return bindings.withColumn("value", function.column(stand_in))
    carried = {f"a{i}" for i in variables if f"a{i}" in bindings.columns and set(function.properties) <= set(bindings.schema[f"a{i}"].dataType.fieldNames())}
    keep = sorted(carried)
    source = bindings.select("bag_id", *dict.fromkeys(names), *keep).distinct() if once else bindings
    args = []
    for k, (i, n) in enumerate(zip(variables, names, strict=True)):
        if f"a{i}" in carried:
            args.append(F.col(f"a{i}"))
            continue
        side = entities.select(F.col("bag_id").alias("b"), F.col("entity_id").alias("e"), F.struct(*function.properties).alias(f"arg{k}"))
        source = source.join(side, (F.col("bag_id") == F.col("b")) & (F.col(n) == F.col("e")), "left").drop("b", "e")
        args.append(F.col(f"arg{k}"))
    valued = source.withColumn("value", function.column(args)).drop(*(f"arg{k}" for k in range(len(names))))
    if not once:
        return valued
    keys = list(dict.fromkeys(names))
    right = valued.select(F.col("bag_id").alias("b"), *(F.col(n).alias(f"k_{n}") for n in keys), "value")
    same = F.col("bag_id") == F.col("b")
    for n in keys:
        same = same & F.col(n).eqNullSafe(F.col(f"k_{n}"))
    return bindings.join(right, same, "left").drop("b", *(f"k_{n}" for n in keys))


def route(value: Column, predicate) -> Column:
    """err if a value is NaN (or nothing decides), else yes or no."""
    if predicate is None:
        return F.lit("err")
    return F.when(value.isNull() | V.any_nan(value), "err").when(predicate.column(value), "yes").otherwise("no")


def propagate(root: Root, bags: DataFrame, entities: DataFrame, participants: DataFrame | None = None, once: bool = False, keep: int | None = None) -> DataFrame:
    """(leaf_id, bag_id, label[, v0 .. v{keep-1}]): the bindings of all bags at the leaves they reach.

    With keep=None bindings are reduced to distinct (leaf, bag), which every score needs. Packed bags bring their
    entities; theirs are not reduced, as only `scores.signatures` follows, which counts repeated rows once.
    """
    if "ents" in bags.columns and keep is None:
        return _propagate_packed(root, bags).select("leaf_id", "bag_id", "label")
    out: list[DataFrame] = []
    carry = needed_properties(root)

    def visit(node, rows: DataFrame, depth: int) -> None:
        if isinstance(node, Leaf):
            kept = [F.col(f"v{i}") if i < depth else F.lit(None).cast("bigint").alias(f"v{i}") for i in range(keep or 0)]
            rows = rows.select(F.lit(node.id).alias("leaf_id"), "bag_id", "label", *kept)
            out.append(rows if keep is not None else rows.distinct())
        elif isinstance(node, Var):
            visit(node.kid, bind(rows, candidates(entities, participants, depth, carry), depth), depth + 1)
        elif isinstance(node, Split):
            if node.function is None or node.predicate is None:
                routed = rows.withColumn("branch", F.lit("err"))
            else:
                routed = with_value(rows, entities, node.function, node.variables, once)
                routed = routed.withColumn("branch", route(F.col("value"), node.predicate)).drop("value")
            if keep is None and all(isinstance(k, Leaf) for k in node.kids()):
                # leaves below: one plan instead of one for each branch
                ids = {b: getattr(node, b).id for b in ("yes", "no", "err") if getattr(node, b) is not None}
                leaf = F.create_map(*(x for b, i in ids.items() for x in (F.lit(b), F.lit(i))))
                out.append(routed.select(F.try_element_at(leaf, F.col("branch")).alias("leaf_id"), "bag_id", "label").where("leaf_id is not null").distinct())
                return
            for branch in ("yes", "no", "err"):
                if getattr(node, branch) is not None:
                    visit(getattr(node, branch), routed.where(F.col("branch") == branch).drop("branch"), depth)
        else:
            visit(node.kid, rows, depth)

    visit(root, bags.select("bag_id", "label"), 0)
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result
