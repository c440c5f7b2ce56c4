"""isoline: asset-network analytics and corpus preparation expressed on Spark DataFrames."""

__version__ = "0.1.0"
