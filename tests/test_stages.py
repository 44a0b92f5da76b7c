"""Stages: manifest last, listed files only, dropped by their owner."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest

from shoalwise.sources import UnfinishedStage, open_stage, write_stage

ROWS = [
    (1, 0.1 + 0.2, "plain", dt.date(1995, 3, 1), True),
    (2, None, "", None, None),
    (None, 1e-300, None, dt.date(1999, 12, 31), False),
    (4, -0.0, 'a "quoted", text\nof two lines ', dt.date(2000, 2, 29), True),
    (4, float("inf"), "\\N ", dt.date(2000, 2, 29), True),
    (5, 2.0, "\\N", None, True),
    (6, 2.0, "\\\\N \\", None, True),
]
KIND = "id long, value double, label string, day date, flag boolean"


def folders(root):
    return sorted(p.name for p in Path(root).iterdir())


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_rows_come_back_as_written(spark, tmp_path, fmt):
    df = spark.createDataFrame(ROWS, KIND).repartition(3)
    with write_stage(df, "rows", fmt, str(tmp_path)) as stage:
        back = open_stage(spark, stage.folder).read()
        assert back.dtypes == df.dtypes
        key = lambda r: repr(tuple(r))
        assert sorted(map(tuple, back.collect()), key=key) == sorted(ROWS, key=key)
    assert folders(tmp_path) == []


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_empty_frame(spark, tmp_path, fmt):
    df = spark.createDataFrame([], KIND)
    stage = write_stage(df, "none", fmt, str(tmp_path))
    assert stage.read().collect() == []
    assert stage.read().dtypes == df.dtypes


def test_half_stages_are_refused(spark, tmp_path):
    df = spark.createDataFrame(ROWS, KIND)
    df.write.parquet(str(tmp_path / "lost" / "data"))
    with pytest.raises(UnfinishedStage, match="no manifest"):
        open_stage(spark, str(tmp_path / "lost"))
    stage = write_stage(df.repartition(2), "kept", "parquet", str(tmp_path))
    # what a stray task leaves beside the listed files is not read
    extra = next(Path(stage.folder, "data").glob("part-*"))
    Path(stage.folder, "data", "part-99999-stray.parquet").write_bytes(extra.read_bytes())
    assert stage.read().count() == len(ROWS)
    extra.unlink()
    with pytest.raises(UnfinishedStage, match="missing or differ"):
        stage.read()


def test_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(3).selectExpr("CAST(raise_error('no') AS int) AS x")
    with pytest.raises(Exception, match="no"):
        write_stage(df, "failed", "csv", str(tmp_path))
    assert folders(tmp_path) == []
