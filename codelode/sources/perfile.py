"""One Python function a file, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an output batch.
ROWS = 4096


def rows_per_file(files: DataFrame, rows: Callable[[str, str], Iterable[dict]], schema: str, errors: tuple = (SyntaxError, ValueError)) -> DataFrame:
    """Rows (dicts) that ``rows(path, content)`` gives for each file; files on which it fails give none from there on."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        held = []
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if content is None:
                    continue
                try:
                    for row in rows(path, content):
                        held.append(row)
                        if len(held) >= ROWS:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held = []
                except errors:
                    continue
        yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)
