"""corpusloom: corpus curation, contamination audit and embedding analytics on PySpark."""

__version__ = "0.1.0"
