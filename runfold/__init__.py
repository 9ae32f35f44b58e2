"""runfold: run-log, policy and text operators on Spark DataFrames.

Every operator takes and returns a ``DataFrame`` and is built from
built-in Spark expressions, joins, aggregates and windows.
"""

__version__ = "0.1.0"
