"""tidegraph: a PySpark-native engine for evolving property graphs kept as ordered edge logs."""
