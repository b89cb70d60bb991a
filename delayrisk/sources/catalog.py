"""Name resolution for the freight tables (S1) and the current namespace.

Jobs ask for a *logical* table name (``activity``, ``fact_load``...).  A
``Tables`` object maps that name either to a catalog table
(``catalog.schema.table`` through ``spark.table``) or, in tests, to the
fixture adapter over the driver's parquet folder.  Either way the result
is a lazy DataFrame, so projections and filters reach the scan.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from . import fixture

INPUT_TABLES = tuple(fixture.VIEWS)


class Tables:
    """Logical table name -> DataFrame."""

    def __init__(self, spark: SparkSession,
                 names: Mapping[str, str] | None = None,
                 factories: Mapping[str, Callable[[], DataFrame]] | None = None,
                 check: bool = True, strict: bool = False):
        self.spark = spark
        self._names = dict(names or {})
        self._factories = dict(factories or {})
        self.check = check
        self.strict = strict
        #: Type differences found on reading, by logical name.
        self.differences: dict[str, list] = {}

    def __getitem__(self, name: str) -> DataFrame:
        return read_table(self, name)

    def __contains__(self, name: str) -> bool:
        return name in self._factories or name in self._names

    @classmethod
    def from_catalog(cls, spark: SparkSession, schema: str = "silver",
                     catalog: str | None = None,
                     overrides: Mapping[str, str] | None = None) -> "Tables":
        """Resolve each logical name to ``[catalog.]schema.silver_<name>``.

        ``fact_load`` lives in the gold zone; ``overrides`` replaces any name.
        """
        prefix = f"{catalog}.{schema}" if catalog else schema
        names = {n: f"{prefix}.silver_{n}" for n in INPUT_TABLES}
        gold = f"{catalog}.gold" if catalog else "gold"
        names["fact_load"] = f"{gold}.fact_load"
        names.update(overrides or {})
        return cls(spark, names=names)

    @classmethod
    def from_fixture(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        """The driver's parquet folder seen through the adapter views."""
        d = fixture.DriverTables(spark, sf_dir)
        factories = {n: (lambda f=f: f(d)) for n, f in fixture.VIEWS.items()}
        return cls(spark, factories=factories)


def read_table(tables: Tables, name: str) -> DataFrame:
    """Scan a table by logical name, checked against its declared columns."""
    if name in tables._factories:
        df = tables._factories[name]()
    elif name in tables._names:
        df = tables.spark.table(tables._names[name])
    else:
        raise KeyError(f"unknown table {name!r}")
    if tables.check and name in schema.INPUTS:
        found = schema.check(df, schema.INPUTS[name], name, tables.strict)
        if found:
            tables.differences[name] = found
            warnings.warn(f"{name}: types differ from the declared ones: {found}", stacklevel=2)
    return df


def use_namespace(spark: SparkSession, database: str, catalog: str | None = None) -> None:
    """Set the current catalog and schema for unqualified names."""
    if catalog:
        spark.catalog.setCurrentCatalog(catalog)
    spark.catalog.setCurrentDatabase(database)
