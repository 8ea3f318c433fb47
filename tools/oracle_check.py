"""Run registered queries in Spark and their SQL oracle in DuckDB; compare.

    python tools/oracle_check.py [sf_dir] [query ...]

Compares row counts, column names and types, and the multiset of rows
(doubles rounded to 6 places).  Exit status 1 if any query differs.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from sentiforge.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402
from sentiforge.session import get_session  # noqa: E402
from sentiforge.sources.tables import TABLES  # noqa: E402

_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if v != v:
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    load_all()
    names = names or list(QUERIES)
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
            stypes = [f.dataType.simpleString() for f in sdf.schema.fields]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR spark {name}: {str(e)[:600]}")
            continue
        ts = time.time() - t0
        if name not in ORACLE:
            print(f"rows-only {name}: {len(srows)} rows  ({ts:.1f}s)")
            continue
        try:
            rel = con.execute(ORACLE[name])
            ocols = [d[0] for d in rel.description]
            otypes = [str(d[1]) for d in rel.description]
            orows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR duckdb {name}: {str(e)[:600]}")
            continue
        problems = []
        if sorted(scols) != sorted(ocols):
            problems.append(f"columns spark={scols} duck={ocols}")
        else:
            sm = dict(zip(scols, stypes))
            om = dict(zip(ocols, otypes))
            for c in scols:
                st = _TYPE.get(sm[c], sm[c])
                if st != om[c] and not (st.startswith("array") and om[c].endswith("[]")):
                    problems.append(f"type {c}: spark={sm[c]} duck={om[c]}")
        if len(srows) != len(orows):
            problems.append(f"rows spark={len(srows)} duck={len(orows)}")
        elif not problems:
            a, b = _rows(scols, srows), _rows(ocols, orows)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                problems.append(f"values differ, e.g. {diff}")
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{status} {name}: {len(srows)} rows ({ts:.1f}s) {'; '.join(problems)[:900]}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
