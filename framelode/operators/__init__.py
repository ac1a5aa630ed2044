"""framelode operators."""
