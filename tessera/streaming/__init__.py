"""Structured Streaming: score arriving rows with a fitted preparation and classifier."""

from .scoring import score_stream

__all__ = ["score_stream"]
