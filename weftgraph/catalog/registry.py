"""The registry of a catalogue module, and rounding on the Spark side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, ShortType


class Registry:
    def __init__(self, prelude: str = ""):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}
        self.prelude = prelude

    def add(self, name: str, sql: str | None = None):
        """Register a function (spark, sf_dir) -> DataFrame; the SQL may use the module's common tables."""

        def put(f):
            self.queries[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
            if sql is not None:
                self.sql[name] = f"{self.prelude}\n{sql}".strip()
            return f

        return put


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as BIGINT, so that both sides' values compare."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (IntegerType, ShortType, LongType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
