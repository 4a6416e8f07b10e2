"""arcspan: architecture-graph analytics on PySpark.

Modules, typed dependency edges, change history and bundle statistics are
DataFrames; every operator is a function from DataFrames to DataFrames.
"""
