"""Named queries over the driver tables, each with its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenumlens.session import apply_conf

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _long_integers(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that both engines return the same type."""
    narrow = {"int", "smallint", "tinyint"}
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in narrow else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under the name of the operator it exercises."""

    def add(run: Run) -> Run:
        @wraps(run)
        def runner(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _long_integers(run(apply_conf(spark), sf_dir))

        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, runner, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
