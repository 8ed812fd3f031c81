"""Tables the registered queries start from, all derived row by row from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linksift.functions.draws import draw, row_hash
from linksift.operators.evaluate import stack_models
from linksift.session import settled
from linksift.sources.links import balanced_links

#: Keys that one task builds links from; a file of keys is small, so its splits alone make few tasks.
KEY_ROWS = 100_000

SCORED_MODELS = ["by_discount", "by_mix", "by_price", "by_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of real pages, taken as legitimate; negative ids keep them apart."""
    return table(spark, sf_dir, "pages").select(
        (-F.col("page_id") - 1).alias("id"), "url", F.lit(0).alias("label")
    )


def keys(spark: SparkSession, sf_dir: str, source: str = "orders") -> DataFrame:
    """The unique key of a given table as ``id``."""
    key = {"orders": "o_orderkey", "customer": "c_custkey"}[source]
    rows = table(spark, sf_dir, source).select(F.col(key).alias("id"))
    tasks = -(-rows.count() // KEY_ROWS)
    return rows.repartition(tasks, "id") if tasks > rows.rdd.getNumPartitions() else rows


def built_links(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    return balanced_links(keys(spark, sf_dir, source))


def links(spark: SparkSession, sf_dir: str, source: str = "orders") -> DataFrame:
    """Two built links per row of ``source`` and the page URLs: (id, url, label)."""
    return built_links(spark, sf_dir, source).unionByName(page_links(spark, sf_dir))


def train_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table of the model queries: ``links`` with a tenth of the labels wrong.

    Which ones is a function of the id. Built links alone are separable, so models would not differ.
    """
    wrong = draw(row_hash(11, "noise", F.col("id")), 0) % 10 == 0
    label = F.when(wrong, 1 - F.col("label")).otherwise(F.col("label"))
    return links(spark, sf_dir).withColumns({"label": label, "is_wrong": wrong})


def odd_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``links`` with most URLs bent the way typed or hostile input is, and some null."""
    kind = draw(row_hash(7, "odd", F.col("id")), 0) % 16
    url = F.col("url")
    bent = (
        F.when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, "")
        .when(kind == 2, " 　 ")
        .when(kind == 3, F.regexp_replace(url, r"^https?://(www\.)?", ""))
        .when(kind == 4, F.concat(F.lit("  "), url, F.lit(" \t")))
        .when(kind == 5, F.upper(url))
        .when(kind == 6, F.replace(url, F.lit("://"), F.lit("://me:pw@")))
        .when(kind == 7, F.concat(url, F.lit("#top?x=1")))
        .when(kind == 8, F.replace(url, F.lit("://"), F.lit("://[")))
        .when(kind == 9, F.concat(F.lit("http://[2001:db8::1]:8080/"), F.col("id").cast("string"), F.lit(";v=1?a=b")))
        .when(kind == 10, F.concat(F.lit("http://²"), F.col("id").cast("string"), F.lit(".٣.example.tk/")))
        .when(kind == 11, F.concat(url, F.lit(";p=1/x;q=2?y")))
        .when(kind == 12, F.concat(F.lit("https://a／"), F.col("id").cast("string"), F.lit(".com/update?z")))
        .when(kind == 13, F.regexp_replace(url, r"^(https?://[^/?]*)", "$1:8080"))
        .when(kind == 14, F.regexp_replace(url, "^https?:", ""))
        .otherwise(url)
    )
    # Settled, since a filter on the URL would repeat the expressions that build it.
    return settled(links(spark, sf_dir).withColumn("url", bent))


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``odd_links``, some with line breaks, back strokes or the text of the null token."""
    url, kind = F.col("url"), F.pmod("id", F.lit(5))
    broken = (
        F.when(kind == 0, F.concat(url, F.lit("\n\r\n\\n\\\\b,\"x\"")))
        .when(kind == 1, F.concat(F.lit("\\N"), url, F.lit("\r")))
        .when((kind == 2) & (F.pmod("id", F.lit(7)) == 0), "\\N")
        .otherwise(url)
    )
    return odd_links(spark, sf_dir).withColumn("url", broken)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of four fixed scoring rules on every line item; returned items are class 1."""
    quantity, discount = F.col("l_quantity"), F.col("l_discount")
    rules = {
        "by_discount": discount * 10 + F.col("l_tax"),
        "by_mix": (quantity / 50 + discount * 10) / 2,
        "by_price": F.col("l_extendedprice") / 100000,
        "by_quantity": quantity / 50,
    }
    items = table(spark, sf_dir, "lineitem")
    base = items.select(
        (F.col("l_orderkey") % 5).cast("int").alias("fold"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        *[rule.alias(name) for name, rule in rules.items()],
    )
    pairs = {name: (F.col(name) >= 0.5, F.col(name)) for name in rules}
    return stack_models(base, pairs, ["fold", "label"])


def wide_table(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """A wide numeric table with its label under another name: id, e0..e63, CLASS_LABEL."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)],
        (F.col("label") < 5).cast("int").alias("CLASS_LABEL"),
    )


def many_classes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, label): five or six rows in each of two classes per order line, so 120,000 classes at 0.01."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    each = lines.select(line.alias("line")).distinct().select("line", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"))
    return each.select((F.col("line") * 16 + F.col("k")).alias("id"), (F.col("line") * 2 + F.col("k") % 2).alias("label"))
