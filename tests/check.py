"""Compare every registered query with its SQL: python tests/check.py SF [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from barleaf.session import local_session  # noqa: E402
from tests.compare import compare, duck  # noqa: E402


def main(sf: str, wanted: list[str]) -> int:
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(), duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    bad = 0
    for name in names:
        t = time.time()
        try:
            if name in sql:
                r = compare(spark, con, folder, queries[name], sql[name])
                ok = r["match"]
                print(f"{'ok  ' if ok else 'DIFF'} {name} rows={r['rows']} spark={r['spark_s']}s duck={r['duck_s']}s", flush=True)
                if not ok:
                    print("   ", r["columns"] if r["columns"][0] != r["columns"][1] else "", "differing lines", r["n_diff"])
                    print("    spark:", *r["only_spark"], sep="\n      ")
                    print("    duck: ", *r["only_duck"], sep="\n      ")
            else:
                n = len(queries[name](spark, folder).collect())
                ok = True
                print(f"rows {name} rows={n} spark={time.time() - t:.2f}s", flush=True)
        except Exception as e:  # report and go on to the next query
            ok = False
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
        bad += not ok
    print(f"{len(names) - bad} of {len(names)} good")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
