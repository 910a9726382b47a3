"""Probity: validity audits of automatic graders, and training-data operators, on Spark."""
