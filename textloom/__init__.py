"""textloom: a PySpark engine for text corpora and the runs trained on them."""

__version__ = "0.1.0"
