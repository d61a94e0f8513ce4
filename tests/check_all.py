"""Command-line check of chosen queries: python tests/check_all.py SF_DIR [prefix ...]"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import comparing
from pyspark.sql import SparkSession

import __spark_entry__ as e

sf, prefixes = sys.argv[1], tuple(sys.argv[2:])
spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
con, oracles, bad = comparing.connect(sf), e.oracle_sql(), []
for name, run in e.queries().items():
    if prefixes and not name.startswith(prefixes):
        continue
    t = time.time()
    try:
        df = run(spark, sf)
        got = comparing.spark_table(df)
        took, note = time.time() - t, "rows only"
        if name in oracles:
            t = time.time()
            want = comparing.duck_table(con, oracles[name])
            duck = time.time() - t
            note = f"ok duck {duck:.2f}"
            if got != want:
                bad.append(name)
                diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:3]
                note = f"DIFF {got[0]} {want[0]} {len(got[1])} {len(want[1])} {str(diff)[:600]}"
            types = comparing.types_differ(df, con, oracles[name])
            if types:
                note += f" TYPES {types}"
        print(f"{name:36s} {took:6.2f}s {len(got[1]):7d} {note}", flush=True)
    except Exception as error:
        bad.append(name)
        print(f"{name:36s} ERROR {type(error).__name__} {str(error)[:700]}", flush=True)
print("BAD:", bad)
