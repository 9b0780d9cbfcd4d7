"""A Spark library for query logs, embeddings and ordinal evaluation."""
