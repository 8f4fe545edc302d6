"""Incremental loads: new payments into the fact table, new customers into the document table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import keyed as K
from ..plans import warehouse as W


def new_payment_facts(payments: DataFrame, last_id: int, members: DataFrame, cards: DataFrame, dates: DataFrame,
                      methods: DataFrame) -> DataFrame:
    """Facts of the payments above the mark."""
    return W.payment_facts(W.payment_keys(K.rows_since(payments, "payment_id", last_id), members, cards, dates, methods))


def stream_payment_facts(payments: DataFrame, members: DataFrame, cards: DataFrame, dates: DataFrame, methods: DataFrame,
                         target: str, checkpoint: str) -> StreamingQuery:
    """The same load on a stream of payment files; the checkpoint is the high-water mark.

    A batch writes under its own number, so a replay after a lost executor or driver overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        facts = W.payment_facts(W.payment_keys(batch, members, cards, dates, methods))
        facts.write.mode("overwrite").parquet(os.path.join(target, f"batch={number}"))

    return (
        payments.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def merge_documents(store: DataFrame, scored: DataFrame) -> DataFrame:
    """Store the documents of recomputed customers over their old ones."""
    return K.upsert(store, scored, ["customer_id"], [F.desc("created_at")])
