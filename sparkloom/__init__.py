"""sparkloom: declarative data flows and data-preparation operators as lazy Spark DataFrames."""

__version__ = "0.1.0"
