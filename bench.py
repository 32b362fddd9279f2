"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from lumengraph.plans import catalog  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("kg_state_collapse", "kg_entry_class", "kg_filter_range", "kg_forward_join", "kg_forward_3hop", "kg_reverse_join", "kg_nested_topk", "kg_orderby_desc_multi", "kg_with_update", "kg_validate_violations", "kg_metadata_types", "kg_lineage_ahead", "kg_acl_can_read", "kg_stream_change_feed")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).collect()  # the first job starts the machine
    took, yardstick = {}, {}
    began = time.time()
    catalog.log(spark, SF, "region", "nation", "customer", "orders")  # the log is written once
    took["write_log"] = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    spark.stop()
    with duckdb.connect(config={"threads": int(CPUS)}) as own:  # the same answers from the tables themselves, which have no history
        for path in Path(SF).glob("*.parquet"):
            own.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        for name in HEADLINE:
            began = time.time()
            own.sql(catalog.ORACLE_SQL[name]).fetchall()
            yardstick[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total of the headline queries and of writing their log", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "duckdb_on_tables": yardstick, "sf": SF, "cpus": CPUS}))


if __name__ == "__main__":
    main()
