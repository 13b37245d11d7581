"""Continuous intake: every micro-batch is verified, in a folder of its own, and what has been done is not done again."""
from pyspark.sql import functions as F

from citegrove.operators import registry
from citegrove.plans.verify import index_tables
from citegrove.streaming.intake import verify_stream

COLUMNS = "id long, documento_id string, tribunal string, natureza string, ano int, relator string, texto string"
SCHEMA = "doc_id string, text string"


def test_batches_are_verified_once(spark, tmp_path):
    base = spark.createDataFrame([(1, "d1", "STJ", "acordao", None, None, "RECURSO ESPECIAL Nº 1.234.567 - PR a"), (2, "d2", "STJ", "sumula", None, None, "Súmula n. 7 do STJ")], COLUMNS)
    built = registry.build_registry(base)
    index = index_tables(built)
    inbox, out, checkpoint = (str(tmp_path / x) for x in ("inbox", "out", "checkpoint"))

    def arrive(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)

    def run():
        verify_stream(spark.readStream.schema(SCHEMA).parquet(inbox), index, out, checkpoint).awaitTermination(120)
        return sorted((r.doc_id, r.kind, r.label, r.id) for r in spark.read.parquet(out).select("doc_id", "kind", "label", F.col("id").cast("long")).collect())
    arrive(("a", "REsp 1.234.567/PR e Súmula 7 do STJ"), ("b", "nada aqui"), ("c", None))
    first = [("a", "acordao", "real", 1), ("a", "sumula", "real", 2)]
    assert run() == first
    assert run() == first
    arrive(("d", "REsp 999.999/SP"))
    assert run() == [*first, ("d", "acordao", "inventada", None)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["batch=0", "batch=1"]
