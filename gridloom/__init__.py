"""gridloom: a PySpark-native document-structure engine.

Documents, HTML pages and PDF layout tables become ordered block DataFrames,
and blocks become structure-preserving chunks and linked option matrices.
"""

__version__ = "0.1.0"
