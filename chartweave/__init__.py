"""Spark jobs over longitudinal clinical records, and over text corpora (``chartweave.llm``)."""
