"""Run as a program: jobs in a session of their own, and what Spark's event log says of their tasks, as one JSON line.

    python tests/measure_jobs.py <scratch folder>
"""

import glob
import json
import os
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ROWS, SAMPLE, FILES, STORED, ARRIVED = 600_000, 50_000, 6, 60_000, 3_000


def of_phases(log: str) -> dict[str, dict[str, int]]:
    """Sums over the tasks of each job group: rows and bytes read, rows shuffled; and the most one task fetched."""
    phase_of, found = {}, defaultdict(lambda: defaultdict(int))
    for line in open(log):
        event = json.loads(line)
        if event["Event"] == "SparkListenerJobStart":
            for stage in event["Stage IDs"]:
                phase_of[stage] = event.get("Properties", {}).get("spark.jobGroup.id", "")
        elif event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
            sums, task = found[phase_of.get(event["Stage ID"], "")], event["Task Metrics"]
            sums["records"] += task["Input Metrics"]["Records Read"]
            sums["bytes"] += task["Input Metrics"]["Bytes Read"]
            sums["shuffled"] += task["Shuffle Write Metrics"]["Shuffle Records Written"]
            read = task["Shuffle Read Metrics"]
            sums["most_fetched"] = max(sums["most_fetched"], read["Remote Bytes Read"] + read["Local Bytes Read"])
    return {phase: dict(sums) for phase, sums in found.items()}


def main(scratch: str) -> None:
    from pyspark.sql import functions as F

    from lotbook.operators import models as M
    from lotbook.operators import sampling as G
    from lotbook.schemas import LISTINGS_RAW
    from lotbook.session import build_session
    from lotbook.sources import files, store

    os.makedirs(f"{scratch}/events")
    spark = build_session(
        "measure", "local[4]", spark__sql__shuffle__partitions="6", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=f"{scratch}/shared", spark__sql__warehouse__dir=f"{scratch}/warehouse",
        spark__eventLog__enabled="true", spark__eventLog__dir=f"file://{scratch}/events", spark__eventLog__compress="false",
        spark__eventLog__rolling__enabled="false", spark__sql__sources__useV1SourceList="parquet,csv,text",
    )
    sc = spark.sparkContext
    sc.setLogLevel("OFF")
    notes: dict[str, object] = {}

    # samples
    spark.range(ROWS).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v")).write.parquet(f"{scratch}/rows")
    rows = spark.read.parquet(f"{scratch}/rows")
    sc.setJobGroup("sample", "")
    notes["sample"] = G.sample_n(rows, SAMPLE, "key").count()
    sc.setJobGroup("cutoff", "")
    notes["cutoff"] = G.digest_cutoff(rows, ROWS // 2, "key", 10)
    sc.setJobGroup("", "")

    # headers
    for i in range(FILES):
        os.makedirs(f"{scratch}/tables", exist_ok=True)
        with open(f"{scratch}/tables/{i}.csv", "w") as out:
            out.write("Price,Make,Model\n" if i % 2 else "Make,Price\n")
            out.write("12345,Ford,Focus\n" * 500_000)
    sc.setJobGroup("headers", "")
    notes["layouts"] = [len(f) for _, f in files._layouts(spark, [f"{scratch}/tables"])]
    sc.setJobGroup("", "")

    # new rows against stored ones
    listing = [F.col("id").cast("double").alias("price"), *[F.lit(c).alias(c) for c in ("make", "model")], F.lit(2015).alias("year"),
               *[F.lit(c).alias(c) for c in ("body_style", "city", "state")], F.lit(1.0).alias("mileage"), F.lit("red").alias("color")]
    kept = store.open_store(spark, f"{scratch}/store", LISTINGS_RAW, buckets=8)
    store.add_batch(spark.range(STORED).select(*listing), kept, 1)
    arrived = spark.range(STORED - ARRIVED // 2, STORED + ARRIVED // 2).select(*listing)
    fresh = store.new_rows(arrived, kept, 2)
    sc.setJobGroup("against stored", "")
    notes["new"] = fresh.count()
    notes["plan"] = fresh._jdf.queryExecution().executedPlan().toString()
    sc.setJobGroup("", "")

    # trees with a wide text column, and with a number in its place
    base = spark.range(40_000).select(
        (10 * (F.col("id") % 13) + 3 * (F.col("id") % 25) + 7 * (F.col("id") % 7) + (F.col("id") * 7919) % 11).cast("double").alias("price"),
        (F.col("id") % 13).cast("double").alias("mileage"), "id",
        F.concat(F.lit("m"), F.col("id") % 25).alias("make"), F.concat(F.lit("s"), F.col("id") % 7).alias("state"),
    )
    number = F.pmod(F.hash("id"), F.lit(5_000))
    tables = {"number": base.withColumn("city", number.cast("double")), "wide": base.withColumn("city", F.concat(F.lit("c"), number))}
    for name, table in tables.items():
        table.write.parquet(f"{scratch}/{name}")
        table = spark.read.parquet(f"{scratch}/{name}")
        features, ready = M._tree_input(table, "price", ["id"], "index", 64)
        notes[f"values {name}"] = table.select("city").distinct().count()
        ready = ready.select("price", "features").repartition(4).persist()
        ready.count()
        sc.setJobGroup(name, "")
        M.RandomForestRegressor(labelCol="price", numTrees=2, maxDepth=5, maxBins=64, seed=1, cacheNodeIds=True).fit(ready)
        sc.setJobGroup("", "")
    spark.stop()
    (log,) = [f for f in glob.glob(f"{scratch}/events/*") if os.path.isfile(f)]
    print(json.dumps({"notes": notes, "phases": of_phases(log)}))


if __name__ == "__main__":
    main(sys.argv[1])
