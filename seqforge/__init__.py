"""seqforge: Spark-native preparation and scoring of ordered-sequence and conversation training data.

Operators take DataFrames/Columns and return DataFrames/Columns; see README.md for the map.
"""

__version__ = "0.1.0"
