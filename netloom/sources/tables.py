"""Graphs and auctions derived from the relational tables, by joins and windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_next(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: a user and the user of the next event, in the order of time. Each hour's first event is linked by hour, so that no task sorts all events."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id").withColumn("hour", F.date_trunc("hour", "ts"))
    inside = Window.partitionBy("hour").orderBy("ts", "event_id")
    linked = events.withColumn("next", F.lead("user_id").over(inside)).withColumn("last", F.lead("event_id").over(inside).isNull())
    # Hours are few (a row each): the first user of the following hour with events.
    hours = events.groupBy("hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    following = hours.withColumn("follows", F.lead("first").over(Window.orderBy("hour"))).select("hour", "follows")
    rows = linked.join(F.broadcast(following), "hour").select(F.col("user_id").alias("src"), F.when(F.col("last"), F.col("follows")).otherwise(F.col("next")).alias("dst"))
    return Graph.from_edges(rows, True)


def hot_pairs(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Pairs a < b of keys in one order, both on returned lines of 40 or more."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 40").select("l_orderkey", F.col(key).alias("k")).distinct()
    one, two = lines.withColumnRenamed("k", "src"), lines.withColumnRenamed("k", "dst")
    return one.join(two, "l_orderkey").filter("src < dst").select("src", "dst").distinct()


def supp_hot(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(hot_pairs(spark, sf_dir, "l_suppkey"), False)


def part_hot(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(hot_pairs(spark, sf_dir, "l_partkey"), False)


def part_dag(spark: SparkSession, sf_dir: str) -> Graph:
    """part_hot with arcs from the lower to the higher key."""
    return Graph.from_edges(hot_pairs(spark, sf_dir, "l_partkey"), True)


def nation_flow(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed, weighted: lines by nation of customer and of supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    flow = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = flow.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return Graph.from_edges(rows, True)


def cust_supp(spark: SparkSession, sf_dir: str) -> Graph:
    """Bipartite: customers and the suppliers of their returned lines, as strings c.. and s..."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return Graph.from_edges(rows, False)


def page_links(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: the host of a page and the first word of the path of each link on it."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return Graph.from_edges(pages.select("src", F.regexp_replace("href", "^[a-z]+://[^/]+|^/+", "").alias("dst")).filter("src != '' AND dst != ''"), True)


def order_auctions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bids, reports, seller): an auction for each nation among its customers.

    bid: a customer's dearest order, whole units to 50; a customer reports to those of the next two keys in the nation; the
    seller knows the three lowest keys.
    """
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("auction"))
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    bidders = customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).select("auction", F.col("c_custkey").alias("bidder"), F.pmod(F.floor("top"), F.lit(51)).cast("double").alias("bid"))
    by = Window.partitionBy("auction").orderBy("bidder")
    chain = bidders.select("auction", "bidder", F.row_number().over(by).alias("n"), F.lead("bidder", 1).over(by).alias("one"), F.lead("bidder", 2).over(by).alias("two"))
    reports = chain.select("auction", "bidder", F.explode(F.array("one", "two")).alias("reported")).filter("reported IS NOT NULL")
    return bidders, reports, chain.filter("n <= 3").select("auction", "bidder")
