"""barleaf: panel analytics expressed as Spark DataFrame operations.

A panel is a table with one row per (ticker, date).  Every public function takes
and returns DataFrames and stays lazy; nothing here collects rows to the driver.
"""

__version__ = "0.1.0"
