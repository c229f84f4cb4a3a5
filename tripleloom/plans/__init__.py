"""Rules to Spark plans."""
