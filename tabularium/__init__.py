"""tabularium: a Spark-first analytics engine for collections of legal and regulatory texts."""

__version__ = "0.1.0"
