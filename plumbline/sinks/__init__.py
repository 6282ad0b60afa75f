"""Writers of tables, documents, labels and lists."""
