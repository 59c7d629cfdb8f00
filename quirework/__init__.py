"""quirework: a PySpark-native engine for libraries of e-books and other text collections."""
