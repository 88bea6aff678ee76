"""Retrieval and text analytics over corpora, as Spark DataFrame plans."""
