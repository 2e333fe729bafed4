"""A linear-time regular expression engine for patterns that are not trusted.

`rlike` backtracks. Here Arrow's RE2 kernel tests the lines, in Arrow batches; look-around and back-references are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lexloom.operators.search import lines


def search_linear(docs: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Matching lines. An invalid pattern raises here, before anything runs."""
    pc.match_substring_regex(pa.array([""]), pattern, ignore_case=ignore_case)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.match_substring_regex(batch.column(batch.schema.get_field_index("line")), pattern, ignore_case=ignore_case))

    own = lines(docs)
    return own.mapInArrow(run, own.schema)
