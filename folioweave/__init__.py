"""folioweave: a PySpark-native engine for citation graphs and the books they come from."""
