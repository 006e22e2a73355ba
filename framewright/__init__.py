"""framewright: a Spark-first engine for frame encoding dataflows and corpus preparation."""
