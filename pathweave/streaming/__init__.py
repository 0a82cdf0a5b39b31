"""Streams of edges."""

from .reach import ReachableStream

__all__ = ["ReachableStream"]
