"""Panel analytics on Spark: entity-by-period data as lazy DataFrame operators."""

__version__ = "0.1.0"
