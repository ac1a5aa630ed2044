"""framelode streaming."""
