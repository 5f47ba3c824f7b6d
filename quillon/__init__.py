"""quillon: a Spark-first engine for auditing collections of repeated, labelled text answers."""
