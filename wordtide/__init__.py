"""wordtide: semantic-drift analytics over book corpora as Spark DataFrame plans."""

__version__ = "0.1.0"
