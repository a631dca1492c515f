"""The splitting CSV reader against the one-task reader."""

import random

import pytest

from groundcheck.sources import csv_records, sinks, tables

PIECES = ["a", "bc", "é漢", '"', '""', "\n", "\r\n", "\n\n", ",", " ", "\\", "x" * 30, '"\n"', "-"]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def texts(n, seed):
    r = random.Random(seed)
    return [(str(i), *["".join(r.choices(PIECES, k=r.randint(0, 12))) or None for _ in range(3)]) for i in range(n)]


def plain(spark, path):
    return spark.read.options(**tables.CSV_OPTIONS, multiLine=True, enforceSchema=False).csv(path)


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_many_splits_equal_one_task(spark, tmp_path, small_splits, seed):
    path = str(tmp_path / "t")
    sinks.write_csv(spark.createDataFrame(texts(400, seed), "id string, context string, prompt string, response string").coalesce(1), path)
    got = tables.read_any_csv(spark, path)
    assert csv_records.split_lines(spark, path).rdd.getNumPartitions() > 8
    assert got.columns == ["id", "context", "prompt", "response"] and as_set(got) == as_set(plain(spark, path)) and got.count() == 400


def test_records_longer_than_splits_and_other_line_ends(spark, tmp_path, small_splits):
    file = tmp_path / "long.csv"
    body = 'id,context\r\n1,"' + "line, of \"\"text\"\"\r\n" * 300 + '"\r\n\r\n2,plain\r\n3,"' + "\n" * 2000 + '"\r\n4,"open at the end\nof the file'
    file.write_bytes(body.encode())
    rows = {r.id: r.context for r in tables.read_any_csv(spark, str(file)).collect()}
    assert set(rows) == {"1", "2", "3", "4"} and rows["2"] == "plain" and rows["3"] == "\n" * 2000
    assert rows["1"] == 'line, of "text"\r\n' * 300 and rows["4"].startswith("open at the end\nof")


def test_a_header_alone(spark, tmp_path):
    (tmp_path / "h.csv").write_text("id,context\n")
    assert tables.read_any_csv(spark, str(tmp_path / "h.csv")).columns == ["id", "context"]
    assert tables.read_any_csv(spark, str(tmp_path / "h.csv")).collect() == []


def test_every_file_needs_the_header(spark, tmp_path):
    for name, head in (("a", "id,context"), ("b", "context,id")):
        (tmp_path / f"{name}.csv").write_text(f"{head}\n1,x\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        tables.read_any_csv(spark, str(tmp_path)).collect()
