"""loomwork: text, graph, matrix, sketch and program analytics on Spark DataFrames."""

__version__ = "0.1.0"
