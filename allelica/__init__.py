"""Spark-native linkage, haplotype and data-quality operators on DataFrames."""
