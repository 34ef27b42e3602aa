"""plotweave: reconcile polygon layers that describe the same ground, on Spark.

Every operator is a function from DataFrames to a DataFrame; nothing is
evaluated until the caller acts on the result, except where a loop has to
look at its own progress (components, assignment, alignment).
"""

__version__ = "0.1.0"
