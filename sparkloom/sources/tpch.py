"""The driver's tables as a property graph. Identifiers are kind * 10**12 + key, so they are unique in the graph."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .graph import PropertyGraph, Route

ORD = 1_000_000_000_000
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, USER, EVENT, TURN, DOCUMENT = range(1, 11)


def uid(kind: int, key):
    return F.lit(kind * ORD).cast("long") + F.col(key).cast("long")


def tpch_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nodes and edges of the star schema. All keys refer to rows that exist, which the graph is told."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    g = PropertyGraph(spark, complete=True)
    at = lambda kind, column: Route(column, kind * ORD, ORD)
    for name, label, kind, key in (("region", "Region", REGION, "r_regionkey"), ("nation", "Nation", NATION, "n_nationkey"), ("customer", "Customer", CUSTOMER, "c_custkey"), ("supplier", "Supplier", SUPPLIER, "s_suppkey"), ("part", "Part", PART, "p_partkey"), ("orders", "Order", ORDER, "o_orderkey")):
        g = g.with_nodes(t[name], label, id=at(kind, key))
    g = g.with_edges(t["nation"].select("n_nationkey", "n_regionkey"), "IN_REGION", at(NATION, "n_nationkey"), at(REGION, "n_regionkey"), between=("Nation", "Region"), single="src")
    g = g.with_edges(t["customer"].select("c_custkey", "c_nationkey"), "IN_NATION", at(CUSTOMER, "c_custkey"), at(NATION, "c_nationkey"), between=("Customer", "Nation"), single="src")
    g = g.with_edges(t["supplier"].select("s_suppkey", "s_nationkey"), "IN_NATION", at(SUPPLIER, "s_suppkey"), at(NATION, "s_nationkey"), between=("Supplier", "Nation"), single="src")
    g = g.with_edges(t["orders"].select("o_custkey", "o_orderkey"), "PLACED", at(CUSTOMER, "o_custkey"), at(ORDER, "o_orderkey"), between=("Customer", "Order"), single="dst")
    item = t["lineitem"]
    # lines of an order and a part are parallel edges: their place among each other is the rank
    place = F.row_number().over(Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")) - 1
    lines = item.select("l_orderkey", "l_partkey", place.alias("rank"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("shipdate"))
    g = g.with_edges(lines, "CONTAINS", at(ORDER, "l_orderkey"), at(PART, "l_partkey"), rank="rank", between=("Order", "Part"))
    pairs = item.select("l_partkey", "l_suppkey").distinct()
    return g.with_edges(pairs, "SUPPLIED_BY", at(PART, "l_partkey"), at(SUPPLIER, "l_suppkey"), between=("Part", "Supplier"))


def events_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """(:User)-[:EMITTED]->(:Event), each event also labelled by its type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = events.select(uid(USER, "user_id").alias("id"), F.col("user_id")).distinct()
    labelled = events.select(uid(EVENT, "event_id").alias("id"), F.array_sort(F.array(F.lit("Event"), F.col("event_type"))).alias("$labels"), "event_id", "event_type", "ts", "value", "props")
    g = PropertyGraph(spark, complete=True).with_nodes(users, "User").with_nodes(labelled)
    return g.with_edges(events.select(uid(USER, "user_id").alias("src"), uid(EVENT, "event_id").alias("dst")), "EMITTED")


def turns_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """(:Turn)-[:NEXT]->(:Turn) within a conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("id", uid(TURN, "conv_id") + 0)
    turns = turns.withColumn("id", F.lit(TURN * ORD).cast("long") + F.col("conv_id") * 1000 + F.col("turn"))
    follows = turns.select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"), "turn").where("turn > 0").drop("turn")
    return PropertyGraph(spark).with_nodes(turns, "Turn").with_edges(follows, "NEXT", between=("Turn", "Turn"))


def documents_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """(:Document)-[:RATED {quality, toxic}]->(:Rating) for the documents that have labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(uid(DOCUMENT, "doc_id").alias("id"), "doc_id", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.select(uid(DOCUMENT + 1, "doc_id").alias("id"), "quality", "toxic")
    links = labels.select(uid(DOCUMENT, "doc_id").alias("src"), uid(DOCUMENT + 1, "doc_id").alias("dst"))
    return PropertyGraph(spark).with_nodes(docs, "Document").with_nodes(ratings, "Rating").with_edges(links, "RATED", between=("Document", "Rating"))
