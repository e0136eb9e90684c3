"""Supply-chain graph (GRF operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flow_shares(flows: DataFrame) -> DataFrame:
    """GRF-01: share of each flow in the buyer's inputs and in the supplier's output; purchases from oneself go."""
    return flows.where("supplier <> buyer").withColumns({"buyer_share": F.try_divide("value", F.sum("value").over(W.partitionBy("buyer"))), "supplier_share": F.try_divide("value", F.sum("value").over(W.partitionBy("supplier")))})


def group_flows(flows: DataFrame, members: DataFrame) -> DataFrame:
    """GRF-03: flows summed between groups; a member of two groups counts in both, none to itself."""
    s = members.select(F.col("node").alias("supplier"), F.col("group").alias("from_group"))
    b = members.select(F.col("node").alias("buyer"), F.col("group").alias("to_group"))
    joined = flows.where("supplier <> buyer").join(s, "supplier").join(b, "buyer").where("from_group <> to_group")
    return joined.groupBy("from_group", "to_group").agg(F.sum(F.col("value").cast("decimal(20,2)")).cast("double").alias("value"))


def walk(edges: DataFrame, start: DataFrame, hops: int, least: float) -> DataFrame:
    """GRF-05: nodes reached over edges of share >= least along paths without cycles, with their strongest path's product.

    A bounded loop of joins; every node keeps each distinct path until the end. edges: src, dst, share; start: node.
    """
    strong = edges.where(F.col("share") >= least).select("src", "dst", "share")
    paths = start.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"), F.lit(1.0).alias("weight"))
    found = None
    for _ in range(hops):
        paths = paths.join(strong, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        paths = paths.select("start", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"), (F.col("weight") * F.col("share")).alias("weight"))
        found = paths if found is None else found.unionByName(paths)
    best = found.groupBy("start", F.col("at").alias("node")).agg(F.max(F.struct(F.round("weight", 9).alias("weight"), (-F.size("path")).alias("n"))).alias("b"))
    return best.select("start", "node", F.col("b.weight").alias("weight"), (-F.col("b.n") - 1).cast("long").alias("hops"))


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRF-06: direct edges of the given nodes in both directions."""
    down = edges.join(nodes, edges["src"] == nodes["node"]).select("node", F.lit("supplies").alias("kind"), F.col("dst").alias("other"), "share")
    up = edges.join(nodes, edges["dst"] == nodes["node"]).select("node", F.lit("buys").alias("kind"), F.col("src").alias("other"), "share")
    return down.unionByName(up)


def hierarchy(codes: DataFrame) -> DataFrame:
    """GRF-02: part_of edges from each code to its longest prefix that is a code too; codes without one have no edge. codes: code."""
    heads = codes.select("code", F.explode(F.transform(F.sequence(F.lit(1), F.length("code")), lambda n: F.substring("code", F.lit(1), n))).alias("parent")).where("parent <> code")
    known = heads.join(codes.select(F.col("code").alias("parent")), "parent", "left_semi")
    return known.groupBy(F.col("code").alias("src")).agg(F.max_by("parent", F.length("parent")).alias("dst")).withColumn("kind", F.lit("part_of"))


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRF-02: edges whose ends are both nodes."""
    return edges.join(nodes.select(F.col("key").alias("src")), "src", "left_semi").join(nodes.select(F.col("key").alias("dst")), "dst", "left_semi")


def company_edges(companies: DataFrame, weights: DataFrame, themes: DataFrame) -> DataFrame:
    """GRF-04: companies to industries by their code's weights, and to the themes that hold one of these industries. companies: company, code; weights: code, industry, weight; themes: industry, theme."""
    to = companies.join(weights, "code").groupBy("company", "industry").agg(F.sum("weight").alias("weight"))
    themed = to.join(themes, "industry").select("company", F.col("theme").alias("to")).distinct()
    return to.select("company", F.col("industry").alias("to"), F.lit("industry").alias("kind"), "weight").unionByName(themed.select("company", "to", F.lit("theme").alias("kind"), F.lit(None).cast("double").alias("weight")))


def members(edges: DataFrame, group: str) -> DataFrame:
    """GRF-07: companies of an industry or theme by weight, unweighted ones last."""
    return edges.where(F.col("to") == group).select("company", "weight").orderBy(F.desc_nulls_last("weight"), "company")
