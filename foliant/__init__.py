"""Document analytics on Spark: DataFrame operators over documents, chunks, cells, vectors and logs."""
