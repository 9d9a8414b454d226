"""hirelake: job-posting analytics on PySpark DataFrames and Structured Streaming."""
