"""Operators on long panels: rolling, cross-section, join, evaluation and portfolio jobs."""
