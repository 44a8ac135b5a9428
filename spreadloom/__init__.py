"""Walk-forward pair and spread analytics on PySpark DataFrames."""
