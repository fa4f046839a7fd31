"""DataFrame operators over members and blocks."""
