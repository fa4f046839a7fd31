"""Engines, trials, archives and scores."""
