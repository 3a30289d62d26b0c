from tidewell.streaming.source import event_time, stream_files
from tidewell.streaming.sinks import drain_append, drain_batches, drain_updates
from tidewell.streaming.state import latest_state_stream, windowed_counts
from tidewell.streaming.quota import QuotaStream

__all__ = [
    "QuotaStream", "drain_append", "drain_batches", "drain_updates", "event_time", "latest_state_stream",
    "stream_files", "windowed_counts",
]
