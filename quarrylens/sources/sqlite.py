"""The six tables of a graph as one SQLite file, for tools that want a file; rows stream through the driver."""

from __future__ import annotations

import sqlite3
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# The tables and their columns.
TABLES = {
    "nodes": "id TEXT PRIMARY KEY, kind TEXT, label TEXT, file TEXT, line INTEGER, cluster_id TEXT, degree INTEGER, degree_centrality REAL, betweenness REAL",
    "edges": "id TEXT PRIMARY KEY, kind TEXT, source TEXT, target TEXT, label TEXT, via TEXT, confidence TEXT",
    "clusters": "id TEXT PRIMARY KEY, algorithm TEXT, idx INTEGER, size INTEGER, share REAL, cohesion REAL, label TEXT, is_giant INTEGER, warning TEXT",
    "hubs": "id TEXT PRIMARY KEY, name TEXT, degree INTEGER, degree_centrality REAL, betweenness REAL, reason TEXT",
    "flows": "id TEXT PRIMARY KEY, name TEXT, entry_point_id TEXT, depth INTEGER, truncated INTEGER, procedure_ids TEXT, sql_ids TEXT",
    "meta": "key TEXT PRIMARY KEY, value TEXT",
}


def _plain(x):
    return ",".join(map(str, x)) if isinstance(x, (list, tuple)) else int(x) if isinstance(x, bool) else round(x, 6) if isinstance(x, float) else x


def write_sqlite(path: str | Path, **tables: DataFrame) -> str:
    """Replaces all six tables; columns go by name, those that a frame lacks are null, and of rows with one key the last stays."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(path) as db:
        for name, columns in TABLES.items():
            db.execute(f"DROP TABLE IF EXISTS {name}")
            db.execute(f"CREATE TABLE {name} ({columns})")
            df = tables.get(name)
            if df is None:
                continue
            names = [c.split()[0] for c in columns.split(", ")]
            has = [c for c in names if c in df.columns]
            rows = (tuple(map(_plain, r)) for r in df.select(*has).toLocalIterator())
            while part := list(islice(rows, 10_000)):
                db.executemany(f"INSERT OR REPLACE INTO {name} ({', '.join(has)}) VALUES ({', '.join('?' * len(has))})", part)
    db.close()
    return str(path)


def read_sqlite(spark: SparkSession, path: str | Path, table: str = "nodes") -> DataFrame:
    """A table of such a file, by key."""
    kinds = {"TEXT": "string", "INTEGER": "long", "REAL": "double"}
    schema = ", ".join(f"{c.split()[0]} {kinds[c.split()[1]]}" for c in TABLES[table].split(", "))
    with sqlite3.connect(path) as db:
        rows = db.execute(f"SELECT * FROM {table} ORDER BY 1").fetchall()
    db.close()
    return spark.createDataFrame(rows, schema)
