"""Rows of a Spark query and of its SQL, made comparable."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings chunks vec_chunks graph_nodes graph_edges chunk_graph_links deletion_log source_weights token_budgets given_names".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return None if v is None else repr(v) if isinstance(v, float) else str(v)


def spark_rows(df) -> list:
    columns = sorted(df.columns)
    return sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=str), columns


def sql_rows(c, sql: str) -> list:
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    at = [names.index(k) for k in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str), sorted(names)
