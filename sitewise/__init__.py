"""sitewise: a PySpark-native engine for auditing, linking, splitting and screening measurement tables."""
