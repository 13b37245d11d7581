"""Continuous intake: filings arrive as a stream, decisions leave as a table."""
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from citegrove.operators.extract import extract_all
from citegrove.operators.resolve import resolve_spans
from citegrove.plans.tables import stored


def verify_stream(docs: DataFrame, index: dict[str, DataFrame], out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Verifies every micro-batch against the registry tables.  A batch is written to its own folder, so a batch that
    is run again after a failure replaces itself.  With an interval ('1 minute') it goes on until stopped, without one it
    ends when all that has arrived is done."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}

    def batch(rows: DataFrame, number: int) -> None:
        spans = stored(extract_all(rows), "stream-spans")
        resolve_spans(spans, index).write.mode("overwrite").parquet(f"{out}/batch={number}")
    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
