"""Query catalogue and shared planning helpers."""
