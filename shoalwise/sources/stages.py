"""Named stages: a result written once, read by others, and dropped by its owner.

A stage is a folder with the data and a manifest.  The manifest is written
last and lists every file with its size, so a run that dies while writing
leaves a folder without one, which nothing reads; readers take only the listed
files and refuse a stage whose files are missing or differ.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalwise.frames import checkpoint_folder
from shoalwise.sources.files import write_table

MANIFEST = "file string, bytes long, format string, schema string"


class UnfinishedStage(ValueError):
    """A stage without a manifest, or whose files are not those of its manifest."""


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Names below ``folder`` and sizes of its data files; their content is not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return listed.select(F.regexp_extract("path", r"/data/(.*)$", 1).alias("file"), F.col("length").alias("bytes"))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _marked(df: DataFrame, pattern: str, by: str) -> DataFrame:
    """Texts that begin with the backslash of the mark for NULL, with another one before it or without."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.regexp_replace(F.col(f"`{c}`"), pattern, by) for c in texts})


@dataclass(frozen=True)
class Stage:
    """A written stage; ``folder`` is all that another session needs to open it."""

    spark: SparkSession
    folder: str

    def read(self) -> DataFrame:
        """The rows, with the names and types they were written with.

        CSV holds no types: values are parsed by the written schema, and a
        value that does not parse raises while the job runs.  A NULL string
        stays NULL and an empty one stays empty.
        """
        if not _exists(self.spark, f"{self.folder}/manifest/_SUCCESS"):
            raise UnfinishedStage(f"{self.folder} has no manifest")
        manifest = self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifest")
        # as many rows as files were written, in one small file
        listed = manifest.collect()
        head = next(r for r in listed if r["file"] is None)
        wanted = {r["file"]: r["bytes"] for r in listed if r["file"] is not None}
        found = {r["file"]: r["bytes"] for r in _files(self.spark, f"{self.folder}/data").collect()} if wanted else {}
        wrong = sorted(f for f, size in wanted.items() if found.get(f) != size)
        if wrong:
            raise UnfinishedStage(f"{self.folder}: {len(wrong)} files are missing or differ, such as {wrong[0]}")
        schema = T.StructType.fromJson(json.loads(head["schema"]))
        if not wanted:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        if head["format"] == "csv":
            reader = reader.options(**CSV, mode="FAILFAST")
        rows = reader.format(head["format"]).load([f"{self.folder}/data/{f}" for f in wanted])
        return _marked(rows, r"^\\\\", r"\\") if head["format"] == "csv" else rows

    def drop(self) -> None:
        """Remove the folder: the manifest first, so that nobody opens half a stage."""
        _delete(self.spark, f"{self.folder}/manifest")
        _delete(self.spark, self.folder)

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


#: How a stage's CSV is written and read: doubles in full, NULL apart from the empty text.
CSV = {
    "header": "true",
    "nullValue": "\\N",
    "quoteAll": "false",
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def write_stage(df: DataFrame, name: str, fmt: str = "parquet", root: str | None = None) -> Stage:
    """Write ``df`` as a stage under ``root``, by default the shared folder, and give its handle.

    The data comes first and the manifest last.  Each call makes a new folder,
    so runs never meet.  As a context the stage is dropped at the end:

        with write_stage(curve, "curve", "csv") as stage:
            slopes = durable(trend(stage.read(), ...))
    """
    spark = df.sparkSession
    folder = f"{(root or checkpoint_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    try:
        if fmt == "csv":
            _marked(df, r"^\\", r"\\\\").write.options(**CSV).csv(f"{folder}/data")
        else:
            write_table(df, f"{folder}/data", fmt)
        head = spark.range(1).select(
            F.lit(None).cast("string").alias("file"), F.lit(0).cast("long").alias("bytes"),
            F.lit(fmt).alias("format"), F.lit(df.schema.json()).alias("schema"),
        )
        files = _files(spark, f"{folder}/data").where(~F.col("file").rlike(r"(^|/)[_.]")).where(F.col("bytes") > 0)
        blank = [F.lit(None).cast("string").alias(c) for c in ("format", "schema")]
        head.unionByName(files.select("file", "bytes", *blank)).coalesce(1).write.json(f"{folder}/manifest")
    except BaseException:
        _delete(spark, folder)
        raise
    return Stage(spark, folder)


def open_stage(spark: SparkSession, folder: str) -> Stage:
    """The stage in a folder; one without a manifest raises."""
    if not _exists(spark, f"{folder}/manifest/_SUCCESS"):
        raise UnfinishedStage(f"{folder} has no manifest")
    return Stage(spark, folder)
