"""statloom: statistics over tables, declared as Spark plans."""

__version__ = "0.1.0"
