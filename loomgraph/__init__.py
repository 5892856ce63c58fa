"""loomgraph: property-graph analytics and retrieval over source code, on Spark DataFrames."""

__version__ = "0.1.0"
