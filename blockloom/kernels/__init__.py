"""Pure functions from bytes to bytes; no Spark."""
