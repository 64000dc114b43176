"""millrace: batch dataflow operators and run-record queries on PySpark DataFrames."""
