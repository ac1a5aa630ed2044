"""framelode functions."""
