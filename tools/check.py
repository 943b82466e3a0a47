"""Compare registered queries with their SQL on a folder of tables: check.py FOLDER [name part ...]"""

import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_connection(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def kind(value):
    return str(value).replace("HUGEINT", "BIGINT")


def canonical(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and getattr(v, "ndim", 1) == 0 and hasattr(v, "item") and isinstance(v.item(), (int, float)):
            x = float(v)
            return f"{x:.6f}".replace("-0.000000", "0.000000")
        return str(v)

    columns = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[columns].itertuples(index=False, name=None))


def compare(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str:
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} / {sorted(sql_pdf.columns)}"
    if len(spark_pdf) != len(sql_pdf):
        return f"rows {len(spark_pdf)} / {len(sql_pdf)}"
    a, b = canonical(spark_pdf), canonical(sql_pdf)
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diffs)} rows differ, first {sorted(spark_pdf.columns)}: {str(diffs[0][0])[:400]} / {str(diffs[0][1])[:400]}"
    kinds = {c: (str(spark_pdf[c].dtype), str(sql_pdf[c].dtype)) for c in spark_pdf.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    return f"ok (types {odd})" if odd else "ok"


if __name__ == "__main__":
    from catalog import ORACLES, QUERIES
    from postlens.session import local_session

    folder, parts = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            t = time.time()
            got = fn(spark, folder).toPandas()
            seconds = time.time() - t
            if name in ORACLES:
                t = time.time()
                want = con.execute(ORACLES[name]).df()
                result = compare(got, want) + f" sql {time.time() - t:.1f}s"
            else:
                result = "rows only"
        except Exception as e:  # report and go on with the next query
            result, seconds, got = "ERROR " + str(e)[:700], 0, []
        bad += not result.startswith(("ok", "rows only"))
        print(f"{name:45s} {len(got):7d} rows {seconds:6.2f}s {result}", flush=True)
    print("failed:", bad)
    sys.exit(bad > 0)
