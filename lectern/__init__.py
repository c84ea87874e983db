"""Spark jobs for literature retrieval data, labelled-scan evaluation and answer monitoring."""
