"""Run every registered query at one scale and print row counts and times."""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagesift.plans.queries import QUERIES  # noqa: E402
from pagesift.session import build_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2:]
spark = build_session("local[8]")
for name, fn in QUERIES.items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        n = df.count()
        print(f"{name:24s} rows={n:8d} {time.time()-t:6.2f}s cols={df.columns}", flush=True)
    except Exception as e:
        print(f"{name:24s} FAILED {type(e).__name__}: {str(e)[:400]}", flush=True)
