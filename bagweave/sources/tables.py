"""Text tables, JSON bag exports, descriptor files and point files, as sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagweave.functions import vectors as V
from bagweave.session import materialize


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Names in the first line; a leading % isn't part of the first one."""
    first = spark.read.text(path).first()
    names = (first[0] if first else "").split()
    if names and names[0].startswith("%"):
        names[0] = names[0][1:]
    return [n for n in names if n]


def grouped_columns(names: list[str]) -> dict[str, list[int]]:
    """Places of each name; a repeated name is one vector property, wherever its repeats stand."""
    out: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        out.setdefault(n, []).append(i)
    return out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated doubles under a header line; surplus cells are ignored, a short or malformed row raises."""
    names = header_of(spark, path)
    rows = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("n"))
    head = " ".join(names)
    cells = F.split(F.trim("value"), r"\s+")
    body = rows.where((F.regexp_replace(F.trim(F.regexp_replace("value", r"^\s*%", "")), r"\s+", " ") != head) & (F.trim("value") != ""))
    short = F.when(F.size(cells) < len(names), F.raise_error(F.concat(F.lit("short row: "), F.col("value"))))
    cell = lambda i: F.coalesce(short.cast("double"), F.get(cells, F.lit(i)).cast("double"))
    return body.select(*((cell(at[0]) if len(at) == 1 else F.array(*(cell(i) for i in at))).alias(name) for name, at in grouped_columns(names).items()))


def bags_from_tables(labels: DataFrame, features: DataFrame, label_column: str) -> tuple[DataFrame, DataFrame]:
    """(bags, entities): labels joined to features by the first column, in any order; a bag without features is empty."""
    if label_column not in labels.columns:
        raise ValueError(f"no label {label_column}")
    key, other = labels.columns[0], features.columns[0]
    bags = labels.select(F.col(key).cast("bigint").alias("bag_id"), (F.col(label_column) != 0).alias("label"))
    # the rows have no key of their own; written, their numbers stay the same for every reader
    entities = materialize(features.withColumn("entity_id", F.monotonically_increasing_id())).withColumnRenamed(other, "bag_key")
    return bags, entities.select(F.col("bag_key").cast("bigint").alias("bag_id"), "entity_id", *(c for c in features.columns[1:]))


def write_table(df: DataFrame, path: str) -> None:
    """White-space separated text with a header line in each file; vectors take one column for each value."""
    vectors = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    sizes = df.agg(*(f(F.size(c)).alias(f"{n}_{c}") for c in vectors for n, f in (("min", F.min), ("max", F.max)))).first() if vectors else {}
    if uneven := [c for c in vectors if sizes[f"min_{c}"] != sizes[f"max_{c}"]]:
        raise ValueError(f"vectors of different lengths in {uneven}")
    widths = {c: (sizes[f"max_{c}"] or 0) if c in vectors else 0 for c in df.columns}
    header = " ".join(" ".join([c] * max(1, w)) for c, w in widths.items())
    line = F.concat_ws(" ", *(V.format_vector(F.col(c)) if w else F.col(c).cast("string") for c, w in widths.items()))
    df.select(line.alias("%" + header)).write.option("header", "true").option("quote", "").csv(path, sep="\u0001")


def prefixed_lines(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith(prefix))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(point): white-space separated numbers without a header."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("point"))


# JSON exports

_ITEM = "struct<type:string,location:array<array<double>>,__instantiable_depth__:bigint,passer:double,receiver:double>"
_GRAPH = f"struct<items:array<{_ITEM}>,__label__:bigint,label:boolean>"


#: Fields of an exported item.
FIELDS = ("location", "passer", "receiver")


def bags_from_json(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(bags, entities) of exports [[graph, ...], [field, ...]]; bag ids count the graphs of each export."""
    graphs = materialize(df.select(column).withColumn("export_id", F.monotonically_increasing_id())).select("export_id", F.posexplode(F.from_json(F.get_json_object(column, "$[0]"), f"array<{_GRAPH}>")).alias("graph_no", "graph"))
    bags = graphs.select("export_id", F.col("graph_no").alias("bag_id"), "graph.label")
    items = graphs.select("export_id", F.col("graph_no").alias("bag_id"), F.posexplode("graph.items").alias("entity_id", "item"))
    return bags, items.select("export_id", "bag_id", "entity_id", F.col("item.type").alias("type"), F.flatten("item.location").alias("location"), F.col("item.__instantiable_depth__").alias("depth"), "item.passer", "item.receiver")


def bags_to_json(bags: DataFrame, entities: DataFrame, fields: Sequence[str] = FIELDS, participants: DataFrame | None = None) -> DataFrame:
    """(bag_id, graph): each bag as a JSON graph whose items carry the fields, vectors as columns.

    The depth of an item is that of the participants (bag_id, depth, entity_id) which pin it, or their number of depths;
    without participants it is the column `depth` of the entities.
    """
    depth = F.col("depth")
    if participants is not None:
        most = participants.agg((F.max("depth") + 1).alias("free"))
        pins = participants.groupBy("bag_id", "entity_id").agg(F.min("depth").alias("pin"))
        # one row
        entities = entities.drop("depth").join(pins, ["bag_id", "entity_id"], "left").join(F.broadcast(most)).withColumn("depth", F.coalesce("pin", "free", F.lit(0)))
    shown = [(V.column_vector(F.col(c)) if entities.schema[c].dataType.typeName() == "array" else F.col(c)).alias(c) for c in fields]
    item = F.struct(F.col("type"), *shown, depth.alias("__instantiable_depth__"), F.lit("Item").alias("__json_class__"))
    items = entities.groupBy("bag_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("entity_id", item.alias("item")))), lambda x: x["item"]).alias("items"))
    graph = F.struct(F.col("items"), F.col("label").cast("int").alias("__label__"), F.col("label"), F.lit("Graph").alias("__json_class__"))
    return bags.join(items, "bag_id", "left").select("bag_id", F.to_json(graph, {"ignoreNullFields": "false"}).alias("graph"))


def export_lines(graphs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(line): the lines, in order, of one document [[graph, ...], [field, ...]] of the rows of `bags_to_json`.

    Written as text in their order they are one JSON document; no task holds more than a part of it.
    """
    spark, inner = graphs.sparkSession, graphs.select(F.lit(1).alias("part"), F.col("bag_id").cast("string").alias("key"), "graph")
    first = graphs.agg(F.min(F.col("bag_id").cast("string")).alias("first"))
    body = inner.join(F.broadcast(first)).select("part", "key", F.concat(F.when(F.col("key") == F.col("first"), "").otherwise(","), "graph").alias("line"))
    ends = spark.createDataFrame([(0, "", "[["), (2, "", "]," + json.dumps(list(fields)) + "]")], "part int, key string, line string")
    return body.unionByName(ends).orderBy("part", "key").select("line")


# descriptor files


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """(file, location, scale, angle, feature) of descriptor files: a line of count and length, then each feature's
    four values and its descriptor over several lines. The counts are checked."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, text in zip(part["name"], part["value"], strict=True):
                numbers = text.split()
                n, size = int(numbers[0]), int(numbers[1])
                values = [float(x) for x in numbers[2:]]
                if len(values) != n * (size + 4):
                    raise ValueError(f"{name}: {n} features of {size} values are announced, {len(values)} numbers are there")
                digits = "".join(c for c in name.rsplit("/", 1)[-1] if c.isdigit())
                for k in range(n):
                    at = values[k * (size + 4) : (k + 1) * (size + 4)]
                    rows.append((int(digits or 0), at[:2], at[2], at[3], at[4:]))
            yield pd.DataFrame(rows, columns=["file", "location", "scale", "angle", "feature"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), "value")
    return files.mapInPandas(parse, "file bigint, location array<double>, scale double, angle double, feature array<double>")


def matching_images(df: DataFrame, vec_col: str, center: list[float], radius: float, image_col: str = "file") -> DataFrame:
    """The distinct images with a feature within the radius of the centre."""
    from bagweave.operators.statistics import range_match

    return range_match(df, vec_col, center, radius).select(image_col).distinct()


# sinks


def point_log(points: DataFrame) -> DataFrame:
    """(line): label and values of each point, one space between them."""
    return points.select(F.concat_ws(" ", F.col("label").cast("int").cast("string"), V.format_vector(F.col("point"))).alias("line"))


def svg(points: DataFrame, radius: float = 1.0) -> str:
    """A drawing of 2-D points, coloured by value; the points' number should be one that a drawing can hold."""
    x, y = F.get("point", F.lit(0)), F.get("point", F.lit(1))
    lo_x, lo_y, hi_x, hi_y, lo, hi = points.agg(F.min(x - radius), F.min(y - radius), F.max(x + radius), F.max(y + radius), F.min("value"), F.max("value")).first()
    shade: Column = F.round((F.col("value") - lo) / (hi - lo if hi > lo else 1.0) * 255).cast("int")
    shapes = points.select(F.format_string('<circle cx="%s" cy="%s" r="%s" fill="rgb(%s,0,%s)"/>', x.cast("string"), y.cast("string"), F.lit(str(radius)), shade.cast("string"), (255 - shade).cast("string")).alias("shape"))
    body = "\n".join(r["shape"] for r in shapes.toLocalIterator())
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{lo_x} {lo_y} {hi_x - lo_x} {hi_y - lo_y}">\n{body}\n</svg>\n'
