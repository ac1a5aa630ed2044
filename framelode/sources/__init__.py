"""framelode sources."""
