"""Retrieval, citation checking and retrieval evaluation over tables, as Spark jobs."""
