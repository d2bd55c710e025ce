"""Opinion analytics as PySpark DataFrame operators.

Every public operator takes DataFrames (or Columns) and returns a DataFrame (or a
Column).  Nothing is collected on the driver except the one-row time window.
"""

__version__ = "0.1.0"
