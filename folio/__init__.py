"""folio: a PySpark-native engine for text-derived indices."""
