"""Catalog, schema and value search over registered views, as an agent's tools see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored


def tables(spark: SparkSession) -> list[str]:
    """Names of tables and views, sorted."""
    return sorted(t.name for t in spark.catalog.listTables())


def kind(type_name: str) -> str:
    """Broad class of a column type."""
    if type_name in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return "integer"
    if type_name in ("float", "double") or type_name.startswith("decimal"):
        return "real"
    if type_name.startswith(("timestamp", "date")):
        return "time"
    return "blob" if type_name == "binary" else "text" if type_name == "string" else "nested"


def columns(spark: SparkSession, names: list[str]) -> DataFrame:
    """(table_name, position, column_name, kind) of the named tables."""
    rows = [(n, i, c, kind(t)) for n in names for i, (c, t) in enumerate(spark.table(n).dtypes)]
    return spark.createDataFrame(rows, "table_name string, position long, column_name string, kind string")


def keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, kind, referenced) of keys that tables without metadata have, of whole-number columns.

    ``unique``: no value comes twice. ``included``: every value occurs in the unique column ``referenced`` of another table. Nulls do not count; a column
    without values is neither. All tables are read once, as rows (column, value), whose counts are taken; a value's columns are then together in one row, as
    many as there are columns, and tell which columns can still hold which.
    """
    names, parts = [], []
    for t, df in tables.items():
        for c, type_name in df.dtypes:
            if kind(type_name) == "integer":
                names.append((len(names), t, c))
                parts.append((t, len(names) - 1, c))
    spark = next(iter(tables.values())).sparkSession
    rows = None
    for t, df in tables.items():
        pairs = [F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("long").alias("v")) for u, i, c in parts if u == t]
        if pairs:
            one = df.select(F.inline(F.array(*pairs)))
            rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return spark.createDataFrame([], "table_name string, column_name string, kind string, referenced string")
    values = stored(rows.where("v is not null").groupBy("i", "v").agg(F.count("*").alias("n")))
    sizes = values.groupBy("i").agg(F.count("*").alias("many"), (F.max("n") == 1).alias("once"))  # a row for each column
    columns_ = spark.createDataFrame(names, "i int, table_name string, column_name string").join(F.broadcast(sizes), "i")
    together = values.groupBy("v").agg(F.collect_list("i").alias("s"))  # as many as there are columns at most
    pairs = together.select(F.explode("s").alias("i"), "s").select("i", F.explode("s").alias("j")).where("i <> j").groupBy("i", "j").agg(F.count("*").alias("shared"))
    held = columns_.where("once").select(F.col("i").alias("j"), F.col("table_name").alias("other"), F.concat_ws(".", "table_name", "column_name").alias("referenced"))
    found = pairs.join(F.broadcast(held), "j").join(F.broadcast(columns_), "i").where((F.col("shared") == F.col("many")) & (F.col("other") != F.col("table_name")))
    unique = columns_.where("once").select("table_name", "column_name", F.lit("unique").alias("kind"), F.lit(None).cast("string").alias("referenced"))
    return unique.unionByName(found.select("table_name", "column_name", F.lit("included").alias("kind"), "referenced"))


def missing(spark: SparkSession, wanted: list[str]) -> list[str]:
    """Wanted tables that the catalog does not have."""
    return sorted(set(wanted) - set(tables(spark)))


def search_values(df: DataFrame, column: str, text: str, limit: int = 20) -> DataFrame:
    """Distinct values of a column that hold a text, at most ``limit`` of them (1 to 20), the first in order."""
    if not 1 <= limit <= 20:
        raise ValueError("limit must be from 1 to 20")
    return df.select(F.col(column)).where(F.instr(F.col(column).cast("string"), text) > 0).distinct().orderBy(column).limit(limit)


def page_schemas(schemas: DataFrame, budget: int, most: int = 5) -> DataFrame:
    """(position, table_name, kept) of schemas (position, table_name, body): a prefix under the byte budget, ``most`` at most."""
    from pyspark.sql import Window

    w = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)  # a request names five tables at most
    size = F.sum(F.octet_length("body")).over(w)
    return schemas.limit(most).select("position", "table_name", (size <= budget).alias("kept"))


def bounded(rows, budget_column, budget: int, partition: str, order: str):
    """Rows that fit a byte budget of their partition, in order, with whether any was cut."""
    from pyspark.sql import Window

    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(partition)
    out = rows.withColumn("used", F.sum(budget_column).over(w)).withColumn("total", F.sum(budget_column).over(every))
    return out.where(F.col("used") <= budget).withColumn("truncated", F.col("total") > budget)


def observation(payload, budget: int):
    """A payload's text, or a summary with its size and hash where it is beyond the budget."""
    summary = F.to_json(F.struct(F.octet_length(payload).alias("original_bytes"), F.sha2(payload, 256).alias("sha256")))
    return F.when(F.octet_length(payload) <= budget, payload).otherwise(summary)
