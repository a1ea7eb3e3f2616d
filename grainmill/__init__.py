"""grainmill: curation of training text on Spark DataFrames."""

__version__ = "0.1.0"
