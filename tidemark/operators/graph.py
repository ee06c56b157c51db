"""Dependency graphs held as DataFrames: ranks and transitive dependents."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.operators.keys import union_all
from tidemark.session import checkpointed, new_folder

# Kinds of dependency that a drop follows.
FOLLOWED = ("n", "a")
RELATION_KINDS = {"r": "Table", "v": "View", "m": "MaterializedView", "S": "Sequence", "i": "Index"}


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parent-first rank of every node (node) under the edges (child, parent).

    A node without parent in the set has level 0, others one more than their
    highest parent. Nodes on or behind a cycle take the level after the last
    and ``in_cycle``. Self edges and edges leaving the set do not count.

    Only nodes that are a parent take part in the rounds, with the edges
    between them; each round settles all that wait for no parent, and only
    those that still wait are written again. The edges of all others, most of
    a wide graph, are looked up once, when the levels of parents are known.
    """
    spark = nodes.sparkSession
    nodes, edges = nodes.select("node"), edges.select("child", "parent").where("child <> parent")
    inner = checkpointed(edges.select(F.col("parent").alias("node")).distinct().join(nodes, "node", "left_semi"))
    # Copies of an edge are added and taken off alike.
    inside = checkpointed(
        edges.join(inner.withColumnRenamed("node", "child"), "child", "left_semi")
        .join(inner.withColumnRenamed("node", "parent"), "parent", "left_semi")
    )
    waits = inside.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("waits"))
    state = inner.join(waits, "node", "left_outer").select("node", F.coalesce("waits", F.lit(0)).alias("waits"))
    folder = new_folder(spark)
    counted = T.StructType([inner.schema["node"], T.StructField("waits", T.LongType()), T.StructField("ready", T.BooleanType())])
    for level in count():
        part = f"{folder}/level={level}"
        state.withColumn("ready", F.col("waits") == 0).write.partitionBy("ready").parquet(part)
        state = spark.read.schema(counted).parquet(part)
        ready = state.where("ready").select(F.col("node").alias("parent"))
        if ready.isEmpty():
            break
        freed = inside.join(ready, "parent").groupBy(F.col("child").alias("node")).agg(F.count("*").alias("freed"))
        state = state.where("NOT ready").join(freed, "node", "left_outer").select(
            "node", (F.col("waits") - F.coalesce("freed", F.lit(0))).alias("waits")
        )
    levels = spark.read.schema(counted.add("level", T.IntegerType())).parquet(folder)
    # Nodes that still wait in the last round hang on a cycle, and so does all behind them.
    parents = levels.where(F.col("ready") | (F.col("level") == level)).select(
        F.col("node").alias("parent"), (F.col("level") + 1).alias("level"), (~F.col("ready")).alias("in_cycle")
    )
    below = edges.join(parents, "parent").select(F.col("child").alias("node"), "level", "in_cycle", F.lit(False).alias("is_node"))
    whole = nodes.select("node", F.lit(0).alias("level"), F.lit(False).alias("in_cycle"), F.lit(True).alias("is_node")).unionAll(below)
    ranked = whole.groupBy("node").agg(
        F.max("level").alias("level"), F.max("in_cycle").alias("in_cycle"), F.max("is_node").alias("is_node")
    ).where("is_node").drop("is_node")
    ranked = checkpointed(ranked)
    if state.isEmpty():
        return ranked
    # They come after the last level of all.
    last = ranked.where("NOT in_cycle").agg(F.max("level")).first()[0]
    after = F.lit(0 if last is None else last + 1)
    return ranked.select("node", F.when(F.col("in_cycle"), after).otherwise(F.col("level")).alias("level"), "in_cycle")


def transitive_dependents(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Distinct objects that depend on each root (root_id) over edges
    (ref_id, obj_id, obj_class, dep_type), with the depth of the first
    reach. A root is not among its own dependents. Without ``max_depth`` the
    search goes on until nothing new is found, which also ends cycles."""
    followed = edges.where(F.col("dep_type").isin(*FOLLOWED)).select("ref_id", "obj_id", "obj_class")
    frontier = roots.select("root_id").distinct().withColumn("ref_id", F.col("root_id"))
    found: list[DataFrame] = []
    for depth in count(1):
        if max_depth is not None and depth > max_depth:
            break
        step = (
            frontier.join(followed, "ref_id").where("obj_id <> root_id")
            .select("root_id", "obj_id", "obj_class").distinct()
        )
        if found:
            step = step.join(union_all(found).drop("depth"), ["root_id", "obj_id", "obj_class"], "left_anti")
        step = checkpointed(step.withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            if not found:
                found.append(step)
            break
        found.append(step)
        frontier = step.select("root_id", F.col("obj_id").alias("ref_id")).distinct()
    return union_all(found)


def catalog_names(
    relations: DataFrame, routines: DataFrame, types: DataFrame, triggers: DataFrame, constraints: DataFrame
) -> DataFrame:
    """Five object catalogs (id, schema, name; relations with relkind, types
    with typtype) as one frame, so that resolving is a single join."""
    kind = F.coalesce(*[F.when(F.col("relkind") == k, F.lit(v)) for k, v in RELATION_KINDS.items()], F.lit("Other"))
    type_kind = F.when(F.col("typtype") == "d", F.lit("Domain")).otherwise(F.lit("DataType"))
    parts = (
        ("relation", relations, kind), ("routine", routines, F.lit("Routine")), ("type", types, type_kind),
        ("trigger", triggers, F.lit("Trigger")), ("constraint", constraints, F.lit("Constraint")),
    )
    return union_all(
        [
            df.select(
                F.lit(cls).alias("obj_class"), F.col("id").cast("bigint").alias("obj_id"),
                F.coalesce("schema", F.lit("")).alias("schema"), F.coalesce("name", F.lit("unknown")).alias("name"),
                obj_type.alias("obj_type"),
            )
            for cls, df, obj_type in parts
        ]
    )


def resolve_objects(closure: DataFrame, names: DataFrame) -> DataFrame:
    """Dependents with schema, name and type; objects of no known type are left out."""
    known = names.where("obj_type <> 'Other'")
    return closure.join(known, ["obj_class", "obj_id"])
