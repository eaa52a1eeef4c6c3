"""Point-in-time analytics on Spark: lazy DataFrame operators over event data."""
