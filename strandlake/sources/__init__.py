"""Readers and writers of the file formats of sequence collections. All read through Spark, compressed or not."""
