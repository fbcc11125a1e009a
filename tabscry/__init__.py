"""tabscry: understand, check and repair Spark tables with DataFrame jobs."""

__version__ = "0.1.0"
