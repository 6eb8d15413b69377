"""basalt: a Spark-native multi-model analytics engine (relational core, time series,
documents, text search, vectors, graphs, Datalog, geo, collections, streams)."""

__version__ = "0.1.0"
