"""borei: a PySpark-native engine for cleaning, segmenting and evaluating Khmer text corpora."""

__version__ = "0.1.0"
