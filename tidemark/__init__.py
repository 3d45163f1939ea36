"""tidemark: keyed time-series analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames and is keyed by one or more
columns (``by``), so the same call serves one series or many millions.
"""
