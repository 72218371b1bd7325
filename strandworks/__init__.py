"""strandworks: long-read sequencing analytics on PySpark DataFrames."""
