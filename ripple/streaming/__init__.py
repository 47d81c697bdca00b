"""Streams: edits to open files, audited as they come."""
