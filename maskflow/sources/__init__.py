"""Reading and writing tables, lookups, documents and configurations."""
