"""JSON-lines and CSV sources and sinks with explicit schemas."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under an explicit schema. A missing path gives an empty frame;
    blank lines are skipped; a malformed line gives a row of nulls, which is dropped."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines where any malformed line fails the read, naming its file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False, keep_nulls: bool = True) -> None:
    """JSON lines, overwritten unless ``append``."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row under an explicit schema."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_csv_table(df: DataFrame, path: str) -> None:
    """CSV with a header row in each part; lists and maps are not taken."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def load_config(path: str) -> dict:
    """A JSON or, where PyYAML is installed, YAML file; values of its 'paths' that are not
    absolute are taken from the file's folder."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        config = json.loads(text)
    else:
        import yaml

        config = yaml.safe_load(text)
    folder = os.path.dirname(os.path.abspath(path))
    if isinstance(config.get("paths"), dict):
        config["paths"] = {k: v if os.path.isabs(v) or "://" in v else os.path.join(folder, v) for k, v in config["paths"].items()}
    return config


def load_env(path: str, into: dict | None = None) -> dict:
    """KEY=VALUE lines, quotes around a value taken off; blank lines and # comments are
    skipped, and keys that ``into`` (default: the environment) has are left as they are."""
    into = os.environ if into is None else into
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, sep, value = line.strip().partition("=")
            if sep and not key.startswith("#"):
                into.setdefault(key.strip(), value.strip().strip("\"'"))
    return into
