"""Spark-first analytics over course corpora: lexical and vector search, curriculum graphs, evaluation and refresh."""
