"""Training-data operators: de-duplication, filtering, mixing, packing and search.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; intermediate tables go to the shared folder named by
``spark.checkpoint.dir`` (see ``scratch``).
"""
