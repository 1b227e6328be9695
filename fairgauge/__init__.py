"""fairgauge: dataset audit, model scoring and governance gates as Spark jobs."""
__version__ = "0.1.0"
