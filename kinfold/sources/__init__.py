"""Readers of the text formats, and writers."""
