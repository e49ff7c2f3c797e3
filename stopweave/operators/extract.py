"""The part of a map that a set of feeds needs: kept ways and nodes in boxes, and relations of what is kept."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopweave.operators import spatial
from stopweave.operators.rules import Rule, any_rule, flat_only


def kept_relations(relations: DataFrame, keep: Iterable[Rule], drop: Iterable[Rule]) -> DataFrame:
    """Relations the rules keep, with ``flat``: not for the sake of what they hold."""
    keep, drop = tuple(keep), tuple(drop)
    t = F.col("tags")
    return relations.filter(any_rule(t, keep, "relation") & ~any_rule(t, drop, "relation")).withColumn("flat", flat_only(t, keep))


def _members(relations: DataFrame, kind: str) -> DataFrame:
    rows = relations.withColumn("_m", F.explode("members")).filter(F.col("_m.type") == kind)
    return rows.select(F.col("_m.ref").alias("id")).distinct()


def extract(tables: dict[str, DataFrame], boxes: DataFrame, keep: Iterable[Rule], drop: Iterable[Rule]) -> dict[str, DataFrame]:
    """nodes, ways and relations that are needed.

    A way stays if it has two nodes or more, some in a box, and it is kept by its tags or by a relation that is
    not flat. A node stays if a kept way uses it, or if it lies in a box and is kept by its tags or a relation
    and not dropped. A relation stays with those members that do.
    """
    keep, drop = tuple(keep), tuple(drop)
    nodes, ways = tables["node"], tables["way"]
    relations = kept_relations(tables["relation"], keep, drop)
    holders = relations.filter("not flat")
    inside = spatial.in_any_box(nodes, boxes).select("id")
    near = ways.withColumn("_n", F.explode("nds")).join(inside.withColumnRenamed("id", "_n"), "_n", "left_semi")
    t = F.col("tags")
    held = _members(holders, "way").withColumn("_held", F.lit(True))
    some = ways.filter(F.size("nds") >= 2).join(near.select("id").distinct(), "id", "left_semi").join(held, "id", "left")
    out_ways = some.filter((F.col("_held").isNotNull() | any_rule(t, keep, "way")) & ~any_rule(t, drop, "way")).drop("_held")
    used = out_ways.select(F.explode("nds").alias("id")).distinct().withColumn("_used", F.lit(True))
    held_nodes = _members(holders, "node").withColumn("_held", F.lit(True))
    rows = nodes.join(used, "id", "left").join(held_nodes, "id", "left").join(inside.withColumn("_in", F.lit(True)), "id", "left")
    wanted = F.col("_held").isNotNull() | any_rule(t, keep, "node")
    own = F.col("_in").isNotNull() & wanted & ~any_rule(t, drop, "node")
    out_nodes = rows.filter(F.col("_used").isNotNull() | own).select(*nodes.columns)
    there = out_nodes.select(F.lit("node").alias("type"), F.col("id").alias("ref")).unionByName(
        out_ways.select(F.lit("way").alias("type"), F.col("id").alias("ref"))
    )
    parts = relations.select("id", "tags", F.posexplode("members").alias("_p", "_m"))
    parts = parts.select("id", "tags", "_p", F.col("_m.type").alias("type"), F.col("_m.ref").alias("ref"), F.col("_m.role").alias("role"))
    left = parts.join(there, ["type", "ref"], "left_semi").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("_p", "type", "ref", "role"))).alias("_m")
    )
    members = F.transform("_m", lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref"), m["role"].alias("role")))
    out_relations = left.join(relations.select("id", "tags"), "id").select("id", members.alias("members"), "tags")
    return {"node": out_nodes, "way": out_ways, "relation": out_relations}


def turn_restrictions(relations: DataFrame, positive: Iterable[Rule], negative: Iterable[Rule], exempt: Iterable[Rule]) -> DataFrame:
    """via, from_way, to_way, positive of relations with one way from, one way to and a via node (the first)."""
    from stopweave.operators.rules import restriction

    def refs(kind: str, role: str):
        return F.transform(
            F.filter("members", lambda m: (m["type"] == kind) & (m["role"] == role)), lambda m: m["ref"]
        )

    rows = relations.withColumn("positive", restriction(F.col("tags"), positive, negative, exempt)).filter("positive is not null")
    rows = rows.select("positive", refs("way", "from").alias("f"), refs("way", "to").alias("t"), refs("node", "via").alias("v"))
    return rows.filter("size(f) = 1 and size(t) = 1 and size(v) >= 1").select(
        F.get("v", 0).alias("via"), F.get("f", 0).alias("from_way"), F.get("t", 0).alias("to_way"), "positive"
    )
