"""Parsing as a stream (an extension): the same formats over files as they arrive."""

from .logs import follow, level_counts, read_stream

__all__ = ["follow", "level_counts", "read_stream"]
