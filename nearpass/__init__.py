"""Terminal-airspace proximity analytics as Spark DataFrame transformations."""
