"""CSV records against the standard library's reader, whatever the byte ranges."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linksift.operators import learners as L
from linksift.plans import training
from linksift.sources import records
from linksift.sources.tables import BAD_ROW


def texts(n=120, seed=2):
    rng = random.Random(seed)
    alphabet = ["a", "b", '"', ",", "\n", "\r\n", " ", "é", "\n\n", "x" * 30]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(12))), round(rng.random(), 3), rng.choice(["", "7"])) for i in range(n)]
    return [*rows, (n, "line\n" * 200, 1.5, "7"), (n + 1, '"' * 40 + "\n" * 40, 2.0, "")]


def written(rows, names, end="\n"):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(names)
    writer.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_as_the_standard_library_reads_them(spark, tmp_path, size, end):
    rows, names = texts(), ["n", "a text", "part", "few"]
    for number in range(2):
        (tmp_path / f"f{number}.csv").write_bytes(written(rows[number::2], names, end).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
        assert size > 64 or lines.rdd.getNumPartitions() > 20
        got = records.read_records(spark, str(tmp_path)).collect()
        cut = records.records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(cut) == len(rows) + 2
    assert all(r[BAD_ROW] is None for r in got)
    want = sorted((n, t, p, int(f) if f else None) for n, t, p, f in rows)
    have = sorted((r["n"], r["a text"] or "", r["part"], r["few"]) for r in got)
    assert have == want


def test_types_are_the_narrowest_that_hold_all_values(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text('a,b,c,d,e,f\n1,1,1,,x,9223372036854775808\n-2,1.5,two,,"",3\n,1e3,3,,y,4\n')
    got = records.read_records(spark, str(file))
    assert [f.dataType.simpleString() for f in got.schema][:6] == ["bigint", "double", "string", "string", "string", "double"]
    assert [r["a"] for r in got.orderBy("c").collect()] == [1, None, -2]


def test_records_that_do_not_fit_are_kept(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text('a,b\n1,"x\ny"\nz,2\n3,4\n5,"open\nto the end')
    got = records.read_records(spark, str(file), StructType().add("a", "long").add("b", "string"))
    rows = {r["a"]: (r["b"], r[BAD_ROW]) for r in got.collect()}
    assert rows[1] == ("x\ny", None) and rows[3] == ("4", None) and rows[None][1] == "z,2" and 5 in rows
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "e.csv").write_text("")
    assert records.records(spark, str(empty)).count() == 0


def test_a_table_of_unknown_columns_trains(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.randrange(9), "note\nof two lines") for i in range(200)]
    rows = [(*r, int(r[1] + r[2] / 9 > 1)) for r in rows]
    (tmp_path / "t.csv").write_text(written(rows, ["id", "first one", "second", "note", "label"]))
    table = records.read_records(spark, str(tmp_path)).drop(BAD_ROW, "note").withColumnRenamed("first one", "first")
    run = training.compare(table, L.Settings(models=[L.LOGREG]))
    assert run.features == ["first", "second"]
    assert training.metrics_table(run).first()["accuracy"] > 0.85
    assert run.predictions.where(F.col("score").isNull()).count() == 0
    run.release()
