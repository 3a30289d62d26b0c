from tidewell.sinks.envelope import read_envelope, write_envelope
from tidewell.sinks.files import write_csv, write_json, write_json_array, write_ndjson, write_parquet, write_tsv
from tidewell.sinks.names import export_name, render_key
from tidewell.sinks.tables import append_table

__all__ = [
    "append_table", "export_name", "read_envelope", "render_key", "write_csv", "write_envelope", "write_json",
    "write_json_array", "write_ndjson", "write_parquet", "write_tsv",
]
