"""Bronze -> silver -> gold layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.text import pg_initcap


def silver_sales(bronze: DataFrame) -> DataFrame:
    """Typed sales (P1, P2, P4). ANSI casts: a non-numeric id fails the job,
    as the typed layer must; use ``safe_cast`` for the non-failing path."""
    qty = F.col("quantity").cast("int")
    price = F.col("unit_price").cast(T.DecimalType(10, 2))
    return bronze.where(F.col("order_date").isNotNull()).select(
        F.col("order_id").cast("int").alias("order_id"),
        F.col("customer_id").cast("int").alias("customer_id"),
        F.col("order_date").cast("date").alias("order_date"),
        F.col("product"),
        qty.alias("quantity"),
        price.alias("unit_price"),
        (qty * price).alias("total_amount"))


def silver_customers(bronze: DataFrame) -> DataFrame:
    """Deduplicated customer dimension.

    DISTINCT ON the cast key keeps an arbitrary row in the reference; here the
    survivor is fixed by ordering on the remaining columns. Done as one
    aggregation (min of a struct) so rows of a hot key are pre-combined
    map-side instead of sorted in one window partition.
    """
    cleaned = bronze.where(F.col("customer_id").isNotNull()).select(
        F.col("customer_id").cast("int").alias("customer_id"),
        pg_initcap(F.trim(F.col("customer_name"))).alias("customer_name"),
        F.lower(F.trim(F.col("email"))).alias("email"),
        F.upper(F.trim(F.col("region"))).alias("region"))
    best = F.min(F.struct("customer_name", "email", "region")).alias("r")
    return cleaned.groupBy("customer_id").agg(best) \
        .select("customer_id", "r.customer_name", "r.email", "r.region")


def safe_cast(df: DataFrame, spec: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """P5: split rows into those whose columns all cast, and rejects.

    Rejects keep the original text plus the list of failing columns. A null
    input is not a cast failure.
    """
    failed = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c))
        for c, t in spec.items()]))
    tagged = df.withColumn("_failed", failed)
    ok = tagged.where(F.size("_failed") == 0).select(
        *[F.col(c).try_cast(spec[c]).alias(c) if c in spec else F.col(c) for c in df.columns])
    rejects = tagged.where(F.size("_failed") > 0).withColumnRenamed("_failed", "failed_columns")
    return ok, rejects


def fct_sales(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """Gold fact (A1, J1): LEFT join sales x customers, count and sum per
    customer, name, region and day. Null keys survive the left join.

    Sales are summed per customer and day before the join: the map side
    combines a hot key (null customers in particular) before any shuffle, and
    the join sees one row per key and day. Customers that the dimension holds
    more than once under one name are counted there, and the sums multiplied,
    so nothing is summed again after the join. Spark decides by size whether
    the dimension is broadcast.
    """
    daily = sales.groupBy("customer_id", "order_date").agg(F.count(F.lit(1)).alias("_n"), F.sum("total_amount").alias("_sum"))
    held = customers.groupBy("customer_id", "customer_name", "region").agg(F.count(F.lit(1)).alias("_held"))
    j = daily.join(held, "customer_id", "left")
    times = F.coalesce("_held", F.lit(1).cast("bigint"))
    kind = daily.select(F.sum("_sum")).schema[0].dataType  # a sum's type
    return j.select("customer_id", "customer_name", "region", "order_date", (F.col("_n") * times).alias("order_count"), (F.col("_sum") * times).cast(kind).alias("daily_revenue"))


# fct_sales contract (fixed values): column, type, NOT NULL
FCT_SALES_CONTRACT = [
    ("customer_id", "integer", True),
    ("customer_name", "text", False),
    ("region", "text", False),
    ("order_date", "date", True),
    ("order_count", "bigint", False),
    ("daily_revenue", "numeric", False),
]
