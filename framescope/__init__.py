"""Exploratory data analysis of tables of any size, as Spark DataFrame operators."""

__version__ = "0.1.0"
