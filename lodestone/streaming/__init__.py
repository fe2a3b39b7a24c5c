"""Streams: debounced change events and incremental indexing."""
