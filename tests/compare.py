"""Compare registered queries with their SQL, as sorted rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=_key)


def differences(spark, db, name, query, sql, sf_dir, show=3):
    """Texts that say where the two results differ."""
    df = query(spark, sf_dir)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    result = db.execute(sql)
    want_columns, want = [c[0] for c in result.description], result.fetchall()
    out = []
    if sorted(got_columns) != sorted(want_columns):
        return [f"columns {sorted(got_columns)} != {sorted(want_columns)}"]
    got, want = rows_of(got_columns, got), rows_of(want_columns, want)
    if len(got) != len(want):
        out.append(f"{len(got)} rows != {len(want)} rows")
    types = [
        {type(v) for r in rows for v in [r[i]] if v is not None}
        for rows in (got, want)
        for i in range(len(got_columns))
    ]
    n = len(got_columns)
    for i in range(n):
        if types[i] != types[n + i] and types[i] and types[n + i]:
            out.append(f"type of {sorted(got_columns)[i]}: {types[i]} != {types[n + i]}")
    for g, w in zip(got, want):
        same = all(
            math.isclose(a, b, rel_tol=1e-12) if isinstance(a, float) and isinstance(b, float) else a == b
            for a, b in zip(g, w)
        )
        if not same:
            out.append(f"spark {str(g)[:700]}\n  sql {str(w)[:700]}")
            if len(out) >= show:
                break
    if not want:
        out.append("no rows at all")
    return out


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or sqls:
        start = time.time()
        try:
            found = differences(spark, db, name, queries[name], sqls[name], sf_dir)
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'BAD' if found else 'ok':4}{name} {time.time() - start:.1f}s", flush=True)
        for text in found:
            print("   ", text, flush=True)
    print("without sql:", sorted(queries.keys() - sqls.keys()))
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
