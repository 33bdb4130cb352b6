"""Lacuna: exemplar-based analytics on gridded and vector data, expressed as Spark plans."""
