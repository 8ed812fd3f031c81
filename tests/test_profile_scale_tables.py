"""Statistics, scaling and files."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linksift.operators import profile as P
from linksift.operators.scale import fit_scaler
from linksift.sources import schemas, tables


def test_describe_equals_pandas(spark, data):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "hot", "gap"]
    df = spark.read.parquet(f"{data}/lineitem.parquet").select(
        *columns[:3],
        F.when(F.col("l_orderkey") % 3 > 0, 5.0).otherwise(F.col("l_tax")).alias("hot"),
        F.when(F.col("l_orderkey") % 2 > 0, F.col("l_tax")).alias("gap"),
    )
    pdf = df.toPandas().describe().T
    for per_range in (50, 10**9):
        got = P.describe(df, columns, None, per_range).toPandas().set_index("feature")
        for column in columns:
            want = pdf.loc[column].rename({"25%": "p25", "50%": "p50", "75%": "p75"})
            for stat, value in want.items():
                assert got.loc[column, stat] == pytest.approx(value, rel=1e-9), (column, stat)


def test_describe_approximate(spark):
    df = spark.range(10001).select(F.col("id").cast("double").alias("x"))
    exact = P.describe(df, ["x"]).first()
    close = P.describe(df, ["x"], accuracy=1000).first()
    assert close.asDict().keys() == exact.asDict().keys()
    assert (close["count"], close["mean"], close["std"]) == tuple(exact)[1:4]
    for quartile in P.QUARTILES:
        assert abs(close[quartile] - exact[quartile]) <= 25


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (4.0, 5)], "a double, b int")
    got = fit_scaler(df, ["a", "b"]).transform(df).orderBy("a").collect()
    pdf = pd.Series([1.0, 2.0, 4.0])
    want = (pdf - pdf.mean()) / pdf.std(ddof=0)
    assert [r["scaled_a"] for r in got] == pytest.approx(list(want))
    assert [r["scaled_b"] for r in got] == [0.0, 0.0, 0.0]


def test_csv_keeps_odd_text(spark, tmp_path):
    urls = ["", None, "  x ", 'a"b', "a,b", "\\N?", "héé", "http://a/b#c", "'", "\\"]
    df = spark.createDataFrame(
        [(i, u, i % 2) for i, u in enumerate(urls)], schemas.LINKS
    )
    path = str(tmp_path / "links")
    tables.write_csv(df, path)
    good, bad = tables.split_bad_rows(tables.read_csv(spark, path, schemas.LINKS))
    assert bad.collect() == []
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, df.collect()))


def test_csv_rows_are_lines_whatever_the_text(spark, tmp_path):
    urls = ["a\nb", "\r", "\n\n", "\\N", "\\n", "\\\n", "\\b\\", 'x",\n"y', "\\r\r\\\\n"]
    df = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)], schemas.LINKS).coalesce(1)
    path = str(tmp_path / "links")
    tables.write_csv(df, path)
    assert spark.read.text(path).count() == len(urls) + 1
    rows = tables.read_csv(spark, path, schemas.LINKS)
    assert sorted(map(tuple, tables.split_bad_rows(rows)[0].collect())) == sorted(map(tuple, df.collect()))


def test_results_kept_as_one_object(spark, tmp_path):
    file = tmp_path / "metrics.json"
    file.write_text('{"A": {"accuracy": 0.5, "f1_score": 1.0},\n "B": {"accuracy": 0.25}}')
    rows = tables.read_named(spark, str(file), "accuracy double, f1_score double").collect()
    assert sorted(map(tuple, rows), key=str) == [("A", 0.5, 1.0), ("B", 0.25, None)]


def test_describe_reports_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    got = {r["feature"]: tuple(r)[1:] for r in P.describe(df, ["a", "b"]).collect()}
    assert got == {"a": (2, 2.0, 1.41, 1.0, 1.5, 2.0, 2.5, 3.0), "b": (0, *[None] * 7)}


def test_bad_rows_are_kept_apart(spark, tmp_path):
    file = tmp_path / "links.csv"
    file.write_text("id,url,label\n1,http://a,0\nx,http://b,1\n3,http://c,1\n4,too,1,many\n")
    df = tables.read_csv(spark, str(file), schemas.LINKS)
    good, bad = tables.split_bad_rows(df)
    assert [r["id"] for r in good.orderBy("id").collect()] == [1, 3]
    assert sorted(r["_bad_row"] for r in bad.collect()) == ["4,too,1,many", "x,http://b,1"]


def test_page_table_schema_reads_in_order(spark, tmp_path):
    names = schemas.PAGES.names
    assert len(names) == 50
    file = tmp_path / "pages.csv"
    file.write_text(",".join(names) + "\n" + ",".join(["7"] + ["0.5"] * 48 + ["1"]) + "\n")
    row = tables.split_bad_rows(tables.read_csv(spark, str(file), schemas.PAGES))[0].first()
    assert (row["id"], row["NumDots"], row["CLASS_LABEL"]) == (7, 0.5, 1)
