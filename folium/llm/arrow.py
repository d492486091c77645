"""Arrow batches in bounded pieces, for operators that run Python on each batch of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PIECE_BYTES = 1_000_000
#: Rows of a batch that Spark sends to Python at most; its default holds ten times as many texts in memory, twice.
BATCH_ROWS = 1000


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about `limit` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def mapped(work: Callable[[pa.RecordBatch], dict], schema: pa.Schema, text: str = "text") -> Callable:
    """A function for mapInArrow that calls work on bounded slices and gives its columns with the given schema."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            yield pa.RecordBatch.from_pydict(work(piece), schema=schema)

    return run


def over(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """rows.mapInArrow with small batches; the setting stays with the session, as the plan runs later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(rows.sparkSession.conf.get(key)) <= BATCH_ROWS:
        rows.sparkSession.conf.set(key, str(BATCH_ROWS))
    return rows.mapInArrow(run, schema)
