"""Training-data operators: filtering, deduplication, mixing, counting and packing.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
when the folder is present.
"""
