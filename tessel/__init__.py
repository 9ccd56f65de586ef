"""Tessel: retrieval, text-tool and event analytics expressed as Spark jobs."""
