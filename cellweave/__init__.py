"""cellweave: single-cell sequencing analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
