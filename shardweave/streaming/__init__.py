"""Streaming twins of the operators that watch events as they arrive."""
