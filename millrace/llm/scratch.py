"""What the operators here share: intermediate tables (see millrace.sources.shared) and how rows are told apart."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.shared import new_path, root, stage

__all__ = ["LAST_ID", "doc_ids", "new_path", "root", "stage", "text_batches"]

#: A null document id counts as this one, the largest.
LAST_ID = (1 << 63) - 1


def doc_ids(docs: DataFrame, name: str = "doc_id") -> Column:
    """The document ids as longs, null as LAST_ID. Ids of other than integer types are refused before any work."""
    kind = docs.schema[name].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{name} must hold integers, not {kind.simpleString()}")
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


_BATCH, _SPLIT = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes"
#: Bytes of files that a task reads at most. By Spark's own measure a table of some GB makes hardly more tasks than cores,
#: so the last few of them, at seconds for each MB of compressed text, keep all but their own cores waiting.
TASK_BYTES = 16 << 20


@contextmanager
def text_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows in each batch that goes to Python, since texts are long, and less text in a task; what runs inside is
    planned so.

    The session's own settings are there again afterwards.
    """
    before = {k: spark.conf.get(k) for k in (_BATCH, _SPLIT)}
    own = int(before[_BATCH])
    spark.conf.set(_BATCH, str(min(rows, own) if own > 0 else rows))
    spark.conf.set(_SPLIT, str(min(TASK_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
