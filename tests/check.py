"""python tests/check.py [-d sf_dir] [name ...]: runs the registered queries against their SQL statements."""

import sys
import time
import traceback

sys.path.insert(0, ".")
sys.path.insert(0, "tests")
import __spark_entry__ as entry  # noqa: E402
from compare import compare  # noqa: E402

from callgauge.session import local_session  # noqa: E402

args = sys.argv[1:]
folder = "/root/testdata/sf0.01"
if args[:1] == ["-d"]:
    folder, args = args[1], args[2:]
spark = local_session("8")
queries, oracle = entry.queries(), entry.oracle_sql()
bad = 0
for name in args or queries:
    if name.startswith("-"):
        continue
    start = time.time()
    try:
        if name in oracle:
            said = compare(spark, folder, queries[name], oracle[name]) or "ok"
        else:
            said = f"ok (rows only: {len(queries[name](spark, folder).collect())})"
    except Exception as e:  # noqa: BLE001
        said = "".join(traceback.format_exception_only(e))[:500]
        if "-v" in sys.argv:
            traceback.print_exc()
    bad += not said.startswith("ok")
    print(f"{name:28s} {time.time() - start:6.2f}s {said}", flush=True)
print("failed:", bad, "of", len(args or queries), "without SQL:", sorted(set(queries) - set(oracle)))
