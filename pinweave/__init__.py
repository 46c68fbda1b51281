"""pinweave: hypergraph analytics and balanced k-way partitioning on Spark DataFrames."""

__version__ = "0.1.0"
