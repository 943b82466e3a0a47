"""Reading and writing: tables, CSV, raw JSON documents, dictionaries."""
