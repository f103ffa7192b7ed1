"""Larder: recipe-corpus preparation and inventory matching as Spark DataFrame jobs."""
