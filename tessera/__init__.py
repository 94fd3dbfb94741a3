"""tessera: a Spark-first document and warehouse analytics engine."""
