"""Tessera: evidence-first retrieval and knowledge-graph analytics on Spark DataFrames."""
