import datetime as dt

import pytest

from tabsmith.operators.drift import drift_report
from tabsmith.sources import sinks
from tabsmith.sources.tables import load_table, resolve_target, strip_names


def test_csv_types_and_missing_texts(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text(" id , x,name,flag,day\n1,1.5,ann,true,2024-01-05\n2,NA,N/A,false,2024-01-06\n3,,bob,true,\n")
    df = load_table(spark, str(p))
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "name": "string", "flag": "boolean", "day": "string"}
    rows = df.orderBy("id").collect()
    assert rows[1]["x"] is None and rows[1]["name"] is None and rows[2]["x"] is None and rows[2]["day"] is None


def test_json_array_and_lines(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text('[{"x": 1, "s": "p"}, {"x": 2, "s": null}]')
    b.write_text('{"x": 1, "s": "p"}\n{"x": 2, "s": null}\n')
    assert load_table(spark, str(a)).count() == load_table(spark, str(b)).count() == 2


def test_unsupported_suffix(spark):
    with pytest.raises(ValueError, match="Unsupported file type"):
        load_table(spark, "/tmp/data.xyz")


def test_target_names(spark):
    df = strip_names(spark.createDataFrame([(1, 2)], ["a ", "Species"]))
    assert df.columns == ["a", "Species"] and resolve_target(df, "species") == "Species"
    with pytest.raises(ValueError, match="not found"):
        resolve_target(df, "nope")
    with pytest.raises(ValueError, match="collide"):
        strip_names(spark.createDataFrame([(1, 2)], ["a", "a "]))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.8)], "k long, prediction string, confidence double")
    sinks.write_scores(df, str(tmp_path / "s"), ["k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).columns == ["k", "prediction", "confidence"]
    report = drift_report(df.select("confidence"), df.select("confidence"), check_ts=dt.datetime(2024, 1, 1))
    for _ in range(2):
        sinks.append_drift_report(report, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    assert sinks.write_table(df, str(tmp_path / "t")).count() == 2
