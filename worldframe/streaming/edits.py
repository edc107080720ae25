"""Edit commands as a stream: every micro-batch rewrites the catalog it touches. An extension beyond batch edits."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from worldframe.operators import edits


def follow(commands: DataFrame, catalog_path: str, entity: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of commands to the Parquet catalog at catalog_path, version by version.

    Each batch reads version n and writes version n + 1 under its batch id, so that a batch which is run again
    after a failure overwrites its own result and nothing else.
    """

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        edits.apply(spark.read.parquet(f"{catalog_path}/v={n}"), rows, entity).write.mode("overwrite").parquet(f"{catalog_path}/v={n + 1}")

    return commands.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
