"""Column-level functions: text, markdown, tables, vectors, signals."""
