"""Incremental forms of the evaluation and hierarchy jobs."""
