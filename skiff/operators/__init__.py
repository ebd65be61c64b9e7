"""Operators over metadata, logs and blobs."""
