"""Whole-query plans: query objects, reports, and the skew-safe building blocks."""
