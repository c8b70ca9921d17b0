"""Compare queries with their SQL: python tests/oracle.py [sf_dir] [name ...]. Used by tests/test_oracle.py too."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(value):
    """A value that compares across both engines."""
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)):
        return None if isinstance(value, float) and math.isnan(value) else float(f"{float(value):.9g}")
    if value is None:
        return None
    return str(value)


def compare(spark, name, query, sql, sf_dir) -> str:
    """Empty if the rows are the same, else what differs."""
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    a = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    b = sorted((tuple(plain(v) for v in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    if a == b:
        return ""
    more, less = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; only Spark {more}; only SQL {less}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from cairn.session import get_spark

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_spark(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    found = entry.queries()
    oracles = entry.oracle_sql()
    for name in sys.argv[2:] or found:
        began = time.time()
        try:
            if name in oracles:
                out = compare(spark, name, found[name], oracles[name], sf_dir) or "same"
            else:
                out = f"{found[name](spark, sf_dir).count()} rows, no SQL"
        except Exception as e:
            out = f"failed: {str(e)[:300]}"
        print(f"{name}: {out[:400]} ({time.time() - began:.1f} s)", flush=True)
