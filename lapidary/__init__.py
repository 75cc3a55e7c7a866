"""A corpus analytics engine on Spark DataFrames.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (column level
functions), ``operators`` (relational operators over records, splits, runs),
``plans`` (end-to-end queries), ``streaming`` (Structured Streaming forms) and
``llm`` (operators for training data, optional: nothing outside imports it).
"""
