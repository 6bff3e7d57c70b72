"""Registers queries with their DuckDB SQL; hands out the tables they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from chainsift.operators import aggregates, graphs, joins
from chainsift.sources.ledger import DUCK, Ledger, from_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ledger(self) -> Ledger:
        return from_tables(self.spark, self.sf_dir)

    @property
    def entries(self) -> DataFrame:
        return self.ledger.entries

    @property
    def tx(self) -> DataFrame:
        return self.ledger.tx

    @property
    def telemetry(self) -> DataFrame:
        return self.ledger.telemetry

    @property
    def labels(self) -> DataFrame:
        return self.ledger.labels

    @cached_property
    def per_tx(self) -> DataFrame:
        return aggregates.per_transaction(self.entries)

    @cached_property
    def transfers(self) -> DataFrame:
        return joins.wallet_projection(self.entries)

    @cached_property
    def clusters(self) -> DataFrame:
        return graphs.entity_clusters(self.entries)


def query(sql: str | None = None, bare: bool = False):
    """Registers a function of ``Tables`` under its name; ``sql`` follows the ledger's CTEs unless ``bare``."""

    def wrap(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql if bare else f"{DUCK}{sql}"
        return f

    return wrap
