"""Document analytics on Spark: text and layout cleaning, segmentation, entity extraction, keyed upsert."""
