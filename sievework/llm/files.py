"""Work on one file at a time, with repeated deliveries settled on the small outcome instead of on the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from sievework.shared import spread


def last_delivered(rows: DataFrame, key: str = "file_id", when: str = "ingested_at") -> DataFrame:
    """One row per key: the one with the latest ``when``; among equal ones the larger hash of the row holds. Rows
    without a key are left out. Keys are nearly unique, so no group is large."""
    rest = [c for c in rows.columns if c not in (key, when)]
    picked = F.max_by(F.struct(*rest), F.struct(F.col(when), F.xxhash64(*rest))).alias("_row")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(picked).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def per_file(files: DataFrame, work: Callable[[str | None, str | None], dict], fields: str, keep: list[str] = ()) -> DataFrame:
    """``work(text, display_path)`` of every row of ``files``, where the row is read; its dictionary becomes the columns
    of ``fields``. Returns one row per file_id, that of its last delivery, with the columns of ``keep`` and ``error``.

    A file on which ``work`` fails does not end the job: its columns are null and ``error`` names what failed. Queries that
    give one row per file show it.
    """
    kept = ["file_id", "ingested_at", *keep]
    slim = spread(files.select(*kept, "display_path", "text"), "file_id")
    made = _parse_datatype_string(f"{fields}, error string")
    schema = StructType([*[slim.schema[c] for c in kept], *made.fields])
    arrow = to_arrow_schema(made)

    def guarded(text: str | None, path: str | None) -> dict:
        try:
            return work(text, path)
        except Exception as x:
            return {"error": f"{type(x).__name__}: {x}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = batch.column(len(kept) + 1).to_pylist(), batch.column(len(kept)).to_pylist()
            rows = [guarded(text, path) for text, path in zip(texts, paths)]
            columns = [pa.array([r.get(f.name) for r in rows], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *arrow.names])

    return last_delivered(slim.mapInArrow(run, schema))


def line_of(text: str, at: int) -> int:
    """Lines start at 1 and end at a line feed."""
    return text.count("\n", 0, at) + 1
