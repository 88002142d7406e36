"""Registered queries over the test tables, and the report battery."""
