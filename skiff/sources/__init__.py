"""Byte streams as rows."""
