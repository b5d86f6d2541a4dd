"""Imports every catalogue module so that all queries are registered."""

from . import q_clean, q_pairs, q_windows, q_approaches, q_stats, q_baseline, q_extra  # noqa: F401
