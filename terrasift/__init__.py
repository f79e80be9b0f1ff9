"""terrasift: a Spark-first engine for survey records, rule tables and mail archives."""

__version__ = "0.1.0"
