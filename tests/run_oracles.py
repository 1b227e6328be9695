"""python tests/run_oracles.py [sf_dir] [name...]: compare every registered query with its SQL."""
import sys
import time

sys.path.insert(0, ".")
from fairgauge.session import get_session  # noqa: E402
from tests.oracle import compare, duck  # noqa: E402
import __spark_entry__ as E  # noqa: E402

args = [a for a in sys.argv[1:] if not a.startswith("--")]
plain = "--plain" in sys.argv          # a session with Spark's defaults, as a driver might build it
oracle_only = "--oracle-only" in sys.argv
sf = args[0] if args else "/root/testdata/sf0.01"
names = args[1:]
if plain:
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false") \
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
else:
    spark = get_session()
con = duck(sf)
qs, sqls = E.queries(), E.oracle_sql()
bad = 0
for name, fn in qs.items():
    if names and name not in names:
        continue
    if oracle_only and name not in sqls:
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in sqls:
            ok, msg = compare(df, con.execute(sqls[name]).df())
        else:
            n = df.count(); ok, msg = True, f"rows-only {n}"
    except Exception as e:  # noqa: BLE001
        ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
    bad += not ok
    print(f"{'OK ' if ok else 'BAD'} {name:40s} {time.time()-t:6.2f}s {msg}", flush=True)
print(f"{bad} failing of {len([n for n in qs if (not names or n in names) and (not oracle_only or n in sqls)])}")
