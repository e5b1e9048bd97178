"""Streams: the fluent builder, stateful processors, exactly-once sinks."""
