"""Streams: an inbox of text books that become chapters as they arrive."""
