"""Sources, sinks, row positions and the driver-table adapters."""

from wattle.sources.positions import dense_position, with_row_id
from wattle.sources.readers import nan_to_null, read_csv, scan_limit, shape
from wattle.sources.sinks import (
    align_to_template, format_fixed, read_segments, write_csv, write_segments,
)

__all__ = ["dense_position", "with_row_id", "nan_to_null", "read_csv", "scan_limit", "shape", "align_to_template", "format_fixed", "read_segments",
           "write_csv", "write_segments"]
