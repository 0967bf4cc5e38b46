"""oppflow: a Spark-first engine for versioned listing data and its texts."""
