"""Hypergraphs in databases, by JDBC; and a SQLite file for single machines."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession

from ..hypergraph import Hypergraph


def save_jdbc(h: Hypergraph, url: str, properties: dict, mode: str = "append") -> None:
    """Rows of one table ``incidences`` keyed by graph name, written by all tasks in parallel."""
    from pyspark.sql import functions as F

    h.incidence.select(F.lit(h.name).alias("graph"), "edge_id", "node_id", "weight").write.jdbc(url, "incidences", mode=mode, properties=properties)


def load_jdbc(spark: SparkSession, url: str, name: str, properties: dict, partitions: int = 16) -> Hypergraph:
    """The graph's rows by hash ranges of the edge, so that many tasks read at once (the hash function is PostgreSQL's)."""
    where = [f"graph = '{name.replace(chr(39), chr(39) * 2)}' AND mod(abs(hashtext(edge_id)), {partitions}) = {i}" for i in range(partitions)]
    return Hypergraph(spark.read.jdbc(url, "incidences", predicates=where, properties=properties).drop("graph"), name=name)


class SqliteStore:
    """A local SQLite file: for graphs of at most ``most_rows`` rows, which pass through the driver."""

    def __init__(self, path: str, most_rows: int = 1_000_000):
        self.path, self.most_rows = path, most_rows
        with self._open() as db:
            db.execute("CREATE TABLE IF NOT EXISTS incidences (graph TEXT, edge_id TEXT, node_id TEXT, weight REAL)")
            db.execute("CREATE INDEX IF NOT EXISTS by_graph ON incidences (graph)")

    def _open(self):
        return sqlite3.connect(self.path)

    def save(self, h: Hypergraph) -> None:
        rows = [tuple(r) for r in h.incidence.select("edge_id", "node_id", "weight").limit(self.most_rows + 1).collect()]
        if len(rows) > self.most_rows:
            raise ValueError("too many rows for a SQLite file")
        with self._open() as db:
            db.execute("DELETE FROM incidences WHERE graph = ?", (h.name,))
            db.executemany("INSERT INTO incidences VALUES (?, ?, ?, ?)", [(h.name, *r) for r in rows])

    def load(self, spark: SparkSession, name: str) -> Hypergraph:
        with self._open() as db:
            rows = db.execute("SELECT edge_id, node_id, weight FROM incidences WHERE graph = ?", (name,)).fetchall()
        if not rows:
            raise KeyError(name)
        return Hypergraph(spark.createDataFrame(rows, "edge_id string, node_id string, weight double"), name=name)

    def list(self) -> list[str]:
        with self._open() as db:
            return [r[0] for r in db.execute("SELECT DISTINCT graph FROM incidences ORDER BY graph")]

    def delete(self, name: str) -> bool:
        with self._open() as db:
            return db.execute("DELETE FROM incidences WHERE graph = ?", (name,)).rowcount > 0


def list_graphs(table: DataFrame) -> DataFrame:
    return table.select("graph").distinct()
