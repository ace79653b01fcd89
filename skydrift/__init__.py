"""skydrift: narrowband drift-search analytics expressed as Spark DataFrame jobs."""
