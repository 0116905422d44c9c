"""tessera: a PySpark-native engine that profiles tables, composes SQL workloads and measures them."""
