"""Population scoring of small networks over record corpora, and training-data operators, on Spark."""
