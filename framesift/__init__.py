"""Curation of image and caption training sets as Spark DataFrame operators."""
