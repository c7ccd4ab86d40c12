"""Event analytics on PySpark: a small command language and a fluent API over Spark DataFrames."""
