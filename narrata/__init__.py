"""Narrative-media analytics on Spark: a versioned star schema, layered views, and corpus operators."""
