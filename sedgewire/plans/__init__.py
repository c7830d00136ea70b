"""Registered queries: each module has QUERIES (name -> f(spark, sf_dir)) and SQL (name -> oracle)."""
