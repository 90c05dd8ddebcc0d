"""The shared folder for checkpoints and written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tidemark import session


#: Rows of whole texts that Spark hands to a Python worker at once; thousands of long texts would fill its memory.
TEXTS_AT_ONCE = 2000


def use_checkpoints(spark: SparkSession) -> None:
    """Use the shared checkpoint folder, and batches of texts that fit small executors."""
    session.use_checkpoints(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_AT_ONCE))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that is written and read again."""
    use_checkpoints(spark)
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file; it has to be there on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
