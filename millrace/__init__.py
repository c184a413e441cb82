"""millrace: Spark-first analytics for equipment telemetry and training-data corpora."""

__version__ = "0.1.0"
