"""millrace: ordered tables, typed columns, property graphs and corpus operators on Spark DataFrames."""

__version__ = "0.1.0"
