"""The fields of many Parquet files from their footers, as a catalogue of uses for the drift operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

_KINDS = (("int", "integer"), ("uint", "integer"), ("float", "number"), ("double", "number"), ("halffloat", "number"), ("decimal", "number"), ("string", "string"), ("large_string", "string"), ("bool", "boolean"), ("list", "array"), ("large_list", "array"), ("struct", "object"), ("map", "object"))


def footer_fields(paths: DataFrame) -> DataFrame:
    """`paths` (`producer`, `file`, `path`) to `producer`, `file`, `field`, `type`, `uses` (the file's rows).

    Only footers are read, by the tasks. Types without a counterpart are named as the file has them. A file that can't
    be opened gives the field `(unreadable)`.
    """
    names = ["producer", "file", "field", "type", "uses"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for producer, file, path in batch[["producer", "file", "path"]].itertuples(index=False):
                try:
                    meta = pq.read_metadata(path)
                    for f in meta.schema.to_arrow_schema():
                        kind = next((k for start, k in _KINDS if str(f.type).startswith(start)), str(f.type))
                        rows.append((producer, file, f.name, kind, meta.num_rows))
                except Exception:  # noqa: BLE001
                    rows.append((producer, file, "(unreadable)", "string", 0))
            yield pd.DataFrame(rows, columns=names)

    return paths.mapInPandas(read, f"producer string, file {paths.schema['file'].dataType.simpleString()}, field string, type string, uses bigint")
