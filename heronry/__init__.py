"""heronry: scoped retrieval, memory event logs and corpus preparation as Spark plans."""
