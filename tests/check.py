"""Run queries against their oracle SQL: python tests/check.py [sf] [name-prefix ...]."""
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, "/root/repo")
import __spark_entry__ as entry  # noqa: E402
from twinraster.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for r in frame.itertuples(index=False):
        rows.append(tuple("NULL" if v is None or (isinstance(v, float) and v != v) or v is pd.NA else (repr(v + 0.0) if isinstance(v, float) else str(v)) for v in r))
    return sorted(rows)


def compare(spark, con, name: str, sf: str) -> str:
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    t0 = time.time()
    ours = fn(spark, sf).toArrow()
    t1 = time.time()
    if sql is None:
        return f"ROWS {ours.num_rows} rows {t1 - t0:.1f}s"
    theirs = con.sql(sql).to_arrow_table()
    t2 = time.time()
    clock = f"{t1 - t0:.1f}s/{t2 - t1:.1f}s"
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"COLUMNS {sorted(ours.column_names)} vs {sorted(theirs.column_names)}"
    kinds = [(c, str(ours.schema.field(c).type), str(theirs.schema.field(c).type)) for c in ours.column_names
             if str(ours.schema.field(c).type).replace("large_", "") != str(theirs.schema.field(c).type).replace("large_", "")]
    a, b = _normal(ours.to_pandas(types_mapper=None)), _normal(theirs.to_pandas())
    if a != b:
        extra = [r for r in a if r not in set(b)][:3]
        missing = [r for r in b if r not in set(a)][:3]
        return f"DIFF {len(a)} vs {len(b)} {clock}\n   spark {extra}\n   oracle {missing}\n   types {kinds}"
    if kinds:
        return f"TYPES {kinds}"
    return f"ok {len(a)} rows {clock}" if a else f"EMPTY {clock}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), connect(sf)
    bad = 0
    for name in entry.queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            verdict = compare(spark, con, name, sf)
        except Exception as error:  # report and go on
            verdict = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += not verdict.startswith("ok")  # a query without SQL counts as well: nothing was compared
        print(f"{name}: {verdict}", flush=True)
        spark.catalog.clearCache()
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
