"""Streaming forms; an extension, as all operators work in batch."""
