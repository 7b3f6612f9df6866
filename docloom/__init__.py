"""Document context engine on Spark: documents are rows, every step is a DataFrame transformation."""
