"""Blocks from streams."""
