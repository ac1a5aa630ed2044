"""framelode plans."""
