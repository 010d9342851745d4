"""duskveil: sensitive-data analytics and text-corpus operators as Spark plans."""

__version__ = "0.1.0"
