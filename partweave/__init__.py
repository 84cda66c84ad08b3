"""partweave: a PySpark-native engine for reconciling parts catalogues.

Every operator takes and returns DataFrames; nothing is collected unless its size is bounded by a
documented parameter.  The subpackage ``llm`` is optional: nothing outside it imports it.
"""

__version__ = "0.1.0"
