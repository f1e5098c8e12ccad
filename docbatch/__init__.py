"""docbatch: Spark jobs that split large batches of scanned pages into documents."""
