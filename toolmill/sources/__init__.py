"""Readers and writers for catalogs, clusters, results and embeddings."""
