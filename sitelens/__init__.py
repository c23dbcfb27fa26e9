"""sitelens: crawled web pages as Spark tables.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); the heavy lifting is left to Catalyst and the built-in SQL functions.
"""

__version__ = "0.1.0"
