"""Footfall: privacy-first web analytics expressed as Spark jobs."""
