"""Checked queries: fixture views, Spark calls and their SQL twins."""
