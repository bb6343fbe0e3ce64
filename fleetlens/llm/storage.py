"""Tables written to the shared folder, to cut lineage and to read a costly result twice."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fleetlens.operators.distributed import ensure_checkpoint_dir

_open = threading.local()


#: For rows of megabytes: Parquet looks at the size of a row group behind each row instead of the
#: hundredth, and so ends it at about these bytes.  Readers decode up to one row group at once.
LARGE_ROWS = {"parquet.block.size": 4_000_000, "parquet.page.size.row.check.min": 1}


#: Bytes that go to a Python worker at once under ``small_batches``, and one row more.
BATCH_BYTES = 4_000_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that begin inside send little to Python workers at once.

    Spark copies a batch several times outside the heap, and its limit of a batch (64 MB) is a setting of
    the session.  Results do not depend on it.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(limit, before)


def save(df: DataFrame, name: str, options: Mapping[str, int] | None = None) -> DataFrame:
    """``df`` written as Parquet under the checkpoint folder, with the writer's ``options``, and read again.

    A lost executor costs no recomputation beyond this table.  The folder belongs to the owner of
    ``spark.checkpoint.dir``; tables are removed here only inside ``leaves_its_result``, as the
    returned DataFrame is lazy.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    if saved := getattr(_open, "saved", None):
        saved[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def leaves_its_result(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``function``, whose saved tables are removed when it ends, but for those that its result reads."""

    @wraps(function)
    def run(*args, **kwargs) -> DataFrame:
        if not hasattr(_open, "saved"):
            _open.saved = []
        _open.saved.append([])
        try:
            result = function(*args, **kwargs)
        finally:
            own = _open.saved.pop()
        read = {part for file in result.inputFiles() for part in file.split("/")}
        for path in own:
            if path.rsplit("/", 1)[1] not in read:
                _remove(result.sparkSession, path)
            elif _open.saved:
                _open.saved[-1].append(path)
        return result

    return run
