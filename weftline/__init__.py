"""weftline: a PySpark-native engine for code-edit datasets.

Everything is ``DataFrame -> DataFrame`` or ``Column -> Column``; Python code
runs only in Arrow-batched functions, where SQL has no equivalent.
"""

__version__ = "0.1.0"
