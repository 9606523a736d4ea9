"""rangeloom: interval signals, features, sequences, points and trees as Spark DataFrame jobs."""

__version__ = "0.1.0"
