"""runpulse: operational analytics over pipeline run logs, as PySpark DataFrames."""

__version__ = "0.1.0"
