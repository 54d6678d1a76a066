"""corpuslab: corpus preparation and classifier evaluation on Spark DataFrames.

Every public operator takes and returns a DataFrame and stays lazy; nothing in
the library collects data to the driver.
"""

__version__ = "0.1.0"
