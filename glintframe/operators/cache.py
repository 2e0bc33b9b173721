"""Derived tables kept under a fingerprint of what they come from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def kept(spark: SparkSession, home: str, mark: str, build: Callable[[], DataFrame], schema: StructType) -> DataFrame:
    """The table under home and mark; where there is none, or one of another schema, it is built and kept.

    A table counts once Spark has committed it, so one that was cut off is built anew.
    """
    path = f"{home}/{mark}"
    try:
        spark.read.text(f"{path}/_SUCCESS")
        found = spark.read.parquet(path)
        if [(f.name, f.dataType.simpleString()) for f in found.schema] == [(f.name, f.dataType.simpleString()) for f in schema]:
            return found
    except AnalysisException:
        pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)
