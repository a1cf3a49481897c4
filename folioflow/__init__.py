"""folioflow: a Spark-first engine for catalogues of ordered text and their ledgers."""

__version__ = "0.1.0"
