"""tidemill: a Spark-first toolkit of sources, lazy row transforms and mergeable aggregations."""

__version__ = "0.1.0"
