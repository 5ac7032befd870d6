"""Run registered queries against their SQL twins: ``check.py [sf] [prefix ...]``."""

import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from harness import DATA, compare, duck  # noqa: E402

from webfacts.registry import load_all  # noqa: E402
from webfacts.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    queries, oracles = load_all()
    spark = local_session()
    folder = f"{DATA}/sf{sf}"
    con = duck(folder)
    bad = 0
    for name, fn in sorted(queries.items()):
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            msg = compare(df, con, oracles[name]) if name in oracles else f"rows={df.count()}"
        except Exception as e:  # report and go on with the next query
            msg = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        ok = msg is None or msg.startswith("rows=")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.1f}s {msg or ''}", flush=True)
    print(f"{bad} bad")


main()
