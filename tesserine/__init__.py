"""Train-light classification, similarity search and anomaly scoring over vectors, as Spark plans."""
