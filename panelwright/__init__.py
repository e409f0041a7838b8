"""Factor research on time-by-symbol panels as ordinary Spark plans."""
