"""quillspark: article analytics on PySpark DataFrames."""
