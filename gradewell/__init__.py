"""gradewell: Spark-native data-quality profiling, ML-evaluation metrics and
episode scoring, expressed with the DataFrame / SQL / Structured Streaming API."""

__version__ = "0.1.0"
