"""Shared folders, lineage cuts and bounded Arrow slices for the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where the setting is absent, and only in local mode, is a temporary folder chosen.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        named = _local.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='panelwright-')}")
    return named


_local: dict[str, str] = {}
_made: list[str] = []


@atexit.register
def _remove() -> None:
    """Takes the tables of this process away when it ends, where they can be reached without Spark."""
    for path in _made:
        with contextlib.suppress(Exception):
            store, top = fs.FileSystem.from_uri(path)
            store.delete_dir(top)


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder in the shared one that nothing has used yet; it goes when the process ends."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table once, so that lost executors don't recompute what led to it.

    A table read back has the size that it has. A checkpointed plan keeps the estimate of the plan
    that it cuts, and over the rounds of a loop with joins these estimates multiply to numbers that
    the driver takes minutes to write down.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch on its way to Python, unless the session sets fewer: rows of text differ in size by a factor of thousands.
BATCH_BYTES, _BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def with_text(docs: DataFrame, text: str, keep: Sequence[str] | None) -> tuple[DataFrame, list[str], str]:
    """What goes to Python: the columns to pass through (all, or ``keep``) and the text once; their names; their schema."""
    kept = docs.columns if keep is None else [*keep]
    sent = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    kinds = dict(sent.dtypes)
    return sent, kept, ", ".join(f"`{c}` {kinds[c]}" for c in kept)


def map_arrow(df: DataFrame, function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches bounded in bytes, so that neither side buffers 10,000 long texts at a time.

    The bound is a setting of the session, read when the job runs; it is lowered here, never raised.
    """
    conf = df.sparkSession.conf
    now = re.fullmatch(r"(\d+)b?", conf.get(_BATCH_SETTING))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each part has about ``most_bytes`` of text (one longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]
