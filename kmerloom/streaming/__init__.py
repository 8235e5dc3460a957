"""Sketches of read files as they arrive: minimum and count merge, so a sketch grows batch by batch."""

from .least_counts import stream_min_count
from .reads import stream_sketch

__all__ = ["stream_min_count", "stream_sketch"]
