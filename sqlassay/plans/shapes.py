"""The query shapes the evaluated statements take, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlassay.plans.fixtures import table


def _ntz(text: str):
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def k1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_name", "c_acctbal")


def k2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("pid"), F.col("p_name").alias("name"))


def k3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


def k4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.col("p_retailprice") > 950).select("p_name", "p_retailprice")


def k5(spark: SparkSession, d: str) -> DataFrame:
    wanted = (F.col("p_type") == "ECONOMY") & F.col("p_name").like("r%")
    return table(spark, d, "part").filter(wanted).select("p_partkey", "p_name")


def k6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.col("p_retailprice").between(920, 960)).select("p_partkey", "p_retailprice")


def k7(spark: SparkSession, d: str) -> DataFrame:
    first_quarter = F.col("o_orderdate").between(_ntz("1997-01-01 00:00:00"), _ntz("1997-03-31 00:00:00"))
    return table(spark, d, "orders").filter(first_quarter).select("o_orderkey", "o_orderdate")


def k8(spark: SparkSession, d: str) -> DataFrame:
    # A day as a range of timestamps reaches the parquet filter; a date cast does not.
    day = (F.col("o_orderdate") >= _ntz("1998-10-03 00:00:00")) & (F.col("o_orderdate") < _ntz("1998-10-04 00:00:00"))
    return table(spark, d, "orders").filter(day).select("o_orderkey", "o_custkey", "o_totalprice")


def k9(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    since = orders.select(F.max("o_orderdate") - F.expr("INTERVAL '90' DAY")).scalar()
    pending = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") >= since)
    return orders.filter(pending)


def k10(spark: SparkSession, d: str) -> DataFrame:
    late = F.col("l_shipdate") >= _ntz("2000-01-01 00:00:00")
    return table(spark, d, "lineitem").filter(late).select(
        "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("ship_year")
    )


def k12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").agg(F.count("*").alias("n"))


def k13(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").filter(done).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


def k14(spark: SparkSession, d: str) -> DataFrame:
    returned = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").filter(returned).agg(F.round(F.avg("l_quantity"), 6).alias("avg_quantity"))


def k15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("customers"))


def k16(spark: SparkSession, d: str) -> DataFrame:
    # One row per customer before the join: the join then moves sums, not orders.
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    return customers.join(spent, customers.c_custkey == spent.o_custkey).select(
        "c_custkey", "c_name", F.round("spent", 2).alias("spent")
    )


def k17(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("avg_price"))
    return brands.filter(F.col("avg_price") > 950).withColumn("avg_price", F.round("avg_price", 4))


def k18(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("quantity"), F.count("*").alias("n")
    )
    return sold.filter((F.col("quantity") > 900) & (F.col("n") > 20))


def k19(spark: SparkSession, d: str) -> DataFrame:
    dear = table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(3)
    return dear.select("p_partkey", "p_name", "p_retailprice")


def k20(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    revenue = lines.groupBy("l_partkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")
    )
    # The sum decides the order, so the top ten are cut before names are joined.
    top = revenue.orderBy(F.desc("revenue"), "l_partkey").limit(10)
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    return top.join(parts, top.l_partkey == parts.p_partkey).select(
        "p_partkey", "p_name", F.round("revenue", 2).alias("revenue")
    )


def k21(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return orders.orderBy(F.desc("n"), "o_custkey")


def k22(spark: SparkSession, d: str) -> DataFrame:
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    wanted = customers.filter(F.col("c_mktsegment") == "MACHINERY")
    return orders.join(wanted, orders.o_custkey == wanted.c_custkey).select("o_orderkey", "c_name", "o_totalprice")


def k23(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter(F.col("l_returnflag") == "A")
    parts, suppliers = table(spark, d, "part"), table(spark, d, "supplier")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .select("l_orderkey", "l_linenumber", "p_name", "s_name")
    )


def k24(spark: SparkSession, d: str) -> DataFrame:
    customers, orders, lines = (table(spark, d, n) for n in ("customer", "orders", "lineitem"))
    parts = table(spark, d, "part").filter(F.col("p_type") == "SMALL")
    suppliers = table(spark, d, "supplier")
    home = (lines.l_suppkey == suppliers.s_suppkey) & (customers.c_nationkey == suppliers.s_nationkey)
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(suppliers, home)
        .select("c_name", "s_name")
        .distinct()
    )


def k25(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "lineitem").filter(F.col("l_quantity") > 48).select("l_partkey", "l_orderkey", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    return parts.join(large, parts.p_partkey == large.l_partkey, "left").select(
        "p_partkey", "p_name", "l_orderkey", "l_quantity"
    )


def k27(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("partkey"), "l_orderkey", "l_linenumber")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_brand")
    return lines.join(parts, "partkey")


def k28(spark: SparkSession, d: str) -> DataFrame:
    """Self join with an inequality: orders below the dearest order of the same customer.

    The second side is one row per customer, so the join never forms all pairs of a
    busy customer's orders.
    """
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    dearest = orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.max("o_totalprice").alias("highest"))
    below = (orders.o_custkey == dearest.custkey) & (orders.o_totalprice < dearest.highest)
    return orders.join(dearest, below).select("o_orderkey", "o_custkey", "o_totalprice", "highest")


def k29(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    large = table(spark, d, "lineitem").filter(F.col("l_quantity") > 48).select("l_partkey")
    return parts.join(large, parts.p_partkey == large.l_partkey, "left_anti")


def k30(spark: SparkSession, d: str) -> DataFrame:
    """Customers who bought brand 1 and brand 2."""
    brands = ["Brand#1", "Brand#2"]
    parts = table(spark, d, "part").filter(F.col("p_brand").isin(brands)).select("p_partkey", "p_brand")
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    bought = lines.join(parts, lines.l_partkey == parts.p_partkey).join(orders, lines.l_orderkey == orders.o_orderkey)
    has = [F.bool_or(F.col("p_brand") == b).alias(f"has_{i}") for i, b in enumerate(brands)]
    return bought.groupBy("o_custkey").agg(*has).filter("has_0 and has_1").select("o_custkey")


def k31(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    average = orders.select(F.avg("o_totalprice")).scalar()
    return orders.filter(F.col("o_totalprice") > average).select("o_orderkey", "o_totalprice")


def k32(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("items"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return joined.groupBy("o_orderstatus").agg(F.round(F.avg("items"), 6).alias("avg_items"))


def k33(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "part").groupBy("p_brand").agg(F.count("p_partkey").alias("parts"))
    return counts.filter(F.col("parts") > 70)


def k34(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").filter(F.col("o_totalprice") > 400000).select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    joined = big.join(customers, big.o_custkey == customers.c_custkey).filter(F.col("c_mktsegment") == "BUILDING")
    return joined.select("c_name", "o_orderkey", "o_totalprice")


def k35(spark: SparkSession, d: str) -> DataFrame:
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    view = customers.join(orders, customers.c_custkey == orders.o_custkey)
    view.select("c_custkey", "c_name", "o_orderkey", "o_orderdate", "o_totalprice").createOrReplaceTempView(
        "customer_orders"
    )
    return spark.sql("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer_orders WHERE o_totalprice < 2000")


QUERIES = {
    "K1": k1, "K2": k2, "K3": k3, "K4": k4, "K5": k5, "K6": k6, "K7": k7, "K8": k8, "K9": k9, "K10": k10,
    "K12": k12, "K13": k13, "K14": k14, "K15": k15, "K16": k16, "K17": k17, "K18": k18, "K19": k19,
    "K20": k20, "K21": k21, "K22": k22, "K23": k23, "K24": k24, "K25": k25, "K27": k27, "K28": k28,
    "K29": k29, "K30": k30, "K31": k31, "K32": k32, "K33": k33, "K34": k34, "K35": k35,
}

ORACLES = {
    "K1": "SELECT c_name, c_acctbal FROM customer",
    "K2": "SELECT p_partkey AS pid, p_name AS name FROM part",
    "K3": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "K4": "SELECT p_name, p_retailprice FROM part WHERE p_retailprice > 950",
    "K5": "SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND p_name LIKE 'r%'",
    "K6": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 920 AND 960",
    "K7": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN '1997-01-01' AND '1997-03-31'",
    "K8": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-10-03'",
    "K9": """SELECT * FROM orders WHERE o_orderstatus = 'P'
             AND o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 90 DAY FROM orders)""",
    "K10": """SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INT) AS ship_year
              FROM lineitem WHERE year(l_shipdate) > 1999""",
    "K12": "SELECT count(*) AS n FROM customer",
    "K13": "SELECT round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'",
    "K14": "SELECT round(avg(l_quantity), 6) AS avg_quantity FROM lineitem WHERE l_returnflag = 'R'",
    "K15": "SELECT c_nationkey, count(c_custkey) AS customers FROM customer GROUP BY c_nationkey",
    "K16": """SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS spent
              FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""",
    "K17": """SELECT p_brand, p_type, round(avg(p_retailprice), 4) AS avg_price
              FROM part GROUP BY p_brand, p_type HAVING avg(p_retailprice) > 950""",
    "K18": """SELECT l_partkey, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem
              GROUP BY l_partkey HAVING sum(l_quantity) > 900 AND count(*) > 20""",
    "K19": "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3",
    "K20": """SELECT p_partkey, p_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name
              ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, p_partkey LIMIT 10""",
    "K21": "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey",
    "K22": """SELECT o_orderkey, c_name, o_totalprice FROM orders INNER JOIN customer ON o_custkey = c_custkey
              WHERE c_mktsegment = 'MACHINERY'""",
    "K23": """SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey
              JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'A'""",
    "K24": """SELECT DISTINCT c_name, s_name FROM customer JOIN orders ON c_custkey = o_custkey
              JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
              JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey WHERE p_type = 'SMALL'""",
    "K25": """SELECT p_partkey, p_name, l_orderkey, l_quantity
              FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 48""",
    "K27": """SELECT partkey, l_orderkey, l_linenumber, p_brand
              FROM (SELECT l_partkey AS partkey, l_orderkey, l_linenumber FROM lineitem) l
              JOIN (SELECT p_partkey AS partkey, p_brand FROM part) p USING (partkey)""",
    "K28": """SELECT a.o_orderkey, a.o_custkey, a.o_totalprice, b.highest
              FROM orders a JOIN (SELECT o_custkey, max(o_totalprice) AS highest FROM orders GROUP BY o_custkey) b
              ON a.o_custkey = b.o_custkey WHERE a.o_totalprice < b.highest""",
    "K29": """SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN
              (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48 AND l_partkey IS NOT NULL)""",
    "K30": """SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
              WHERE p_brand IN ('Brand#1', 'Brand#2') GROUP BY o_custkey HAVING count(DISTINCT p_brand) = 2""",
    "K31": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "K32": """SELECT o_orderstatus, round(avg(items), 6) AS avg_items
              FROM (SELECT l_orderkey, sum(l_quantity) AS items FROM lineitem GROUP BY l_orderkey) i
              JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus""",
    "K33": """WITH brands AS (SELECT p_brand, count(p_partkey) AS parts FROM part GROUP BY p_brand)
              SELECT p_brand, parts FROM brands WHERE parts > 70""",
    "K34": """WITH big AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000)
              SELECT c_name, o_orderkey, o_totalprice FROM big JOIN customer ON o_custkey = c_custkey
              WHERE c_mktsegment = 'BUILDING'""",
    "K35": """WITH customer_orders AS (SELECT c_custkey, c_name, o_orderkey, o_orderdate, o_totalprice
                FROM customer JOIN orders ON c_custkey = o_custkey)
              SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer_orders WHERE o_totalprice < 2000""",
}
