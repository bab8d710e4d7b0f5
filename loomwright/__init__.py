"""Relational feature factory on Spark: related tables in, one scored flat feature table out."""
