"""trawl: a Spark-native hybrid retrieval, indexing and corpus-processing engine."""

__version__ = "0.1.0"
