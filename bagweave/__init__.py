"""bagweave: relational analytics over labelled bags of entities, on Spark DataFrames."""

__version__ = "0.1.0"
