"""Knowledge graphs from heterogeneous data, as Spark plans."""
