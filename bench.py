"""

BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (runs per query, median counts), BENCH_PART_ROWS and
BENCH_PARTS (rows per blob and blobs of the compaction workload, 500,000 and 16 as in the baseline; 0 leaves it out).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from statelake import get_session
from statelake.operators import lww
from statelake.plans.registry import QUERIES
from statelake.session import scratch_path
from statelake.sinks.tables import write_table
from statelake.sources import blob, generator
from statelake import schemas

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
PART_ROWS = int(os.environ.get("BENCH_PART_ROWS", "500000"))
PARTS = int(os.environ.get("BENCH_PARTS", "16"))
WINDOWS = (1, 4, 16)
UPDATE_RATIO = 0.5

HEADLINE = (
    "lww_events", "lww_orders", "lww_filtered", "asof_blob_index", "live_count_as_written_w4", "live_view_w4",
    "lww_key_count", "upsert_orders", "blob_decode_roundtrip", "partitioned_write_read", "flatten_storage_diffs",
    "flatten_contracts", "index_resolve", "complete_sets", "incremental_new_files", "wallet_share", "top_writers",
    "latest_nonce_numeric", "catalog_merge", "stream_late_data", "sql_grouping_sets",
)
# timed as well, outside the sum, which stays comparable from round to round
ALSO = ("asof_join_events", "events_in_windows", "history_as_of", "snapshot_changes", "snapshot_live_count", "blob_source_sql")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(step) -> float:
    start = time.perf_counter()
    step()
    return round(time.perf_counter() - start, 3)


def median(step, runs: int) -> float:
    return round(statistics.median(timed(step) for _ in range(runs)), 3)


def spread(spark, root: str) -> str:
    """The tables as folders of several files, written before anything is timed: the given ones are one row group each,
    which is one task however many cores there are."""
    where = scratch_path(spark, "tables")
    for file in sorted(os.listdir(root)):
        if file.endswith(".parquet"):
            spark.read.parquet(f"{root}/{file}").repartition(2 * CPUS).write.parquet(f"{where}/{file}")
    return where


def compaction(spark) -> dict[str, float]:
    """Decode, compact all but the last W blobs to files, count live keys. File reads are inside every time."""
    root, out = scratch_path(spark, "bench"), {}
    keys = generator.keyspace_for(PART_ROWS * PARTS, UPDATE_RATIO)
    state = generator.generate_state(spark, PART_ROWS, PARTS, keyspace=keys)
    blob.write_blobs(state, f"{root}/blob", rows_per_file=PART_ROWS)
    out["decode_all"] = timed(lambda: write_table(blob.read_blobs(spark, f"{root}/blob"), f"{root}/hot"))
    hot = spark.read.schema(schemas.STATE).parquet(f"{root}/hot")
    for window in WINDOWS:
        if (parts := lww.split_window(hot, PARTS, window)) is None:
            continue
        base, recent = parts
        where = f"{root}/base-{window}"
        out[f"compact_w{window}"] = timed(lambda: write_table(lww.lww(base), where))
        current = spark.read.schema(schemas.STATE).parquet(where)
        out[f"live_w{window}"] = timed(lambda: run(lww.live_count_as_written(current, recent)))
        out[f"live_view_w{window}"] = timed(lambda: run(lww.live_view(current, recent)))
        out[f"compact_and_live_w{window}"] = round(out[f"compact_w{window}"] + out[f"live_w{window}"], 3)
    return out


def main() -> None:
    spark = get_session(
        "bench", f"local[{CPUS}]", spark_sql_shuffle_partitions=str(2 * CPUS), spark_ui_enabled="false",
        spark_driver_memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, tables = {}, spread(spark, SF_DIR)
    for name in (*HEADLINE, *ALSO):
        run(QUERIES[name](spark, tables))
        times[name] = median(lambda: run(QUERIES[name](spark, tables)), RUNS)
    total = round(sum(times[name] for name in HEADLINE), 3)
    if PART_ROWS and PARTS:
        times.update({f"state_{PART_ROWS * PARTS}_{k}": v for k, v in compaction(spark).items()})
    print(json.dumps({
        "metric": "sum of median seconds of the headline queries", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")), "cores": CPUS, "memory": os.environ.get("BENCH_MEMORY", "12g"),
        "runs": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
