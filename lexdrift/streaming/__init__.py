from lexdrift.streaming.incremental import (
    read_counters,
    read_dump_shards,
    read_shards,
    start_compare,
    start_counters,
)

__all__ = ["read_counters", "read_dump_shards", "read_shards", "start_compare", "start_counters"]
