"""Search and mining of document corpora as PySpark DataFrame operators."""
