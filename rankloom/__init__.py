"""Rank-coded text compression on Spark."""
