"""Reading and writing: tables, files, messages."""
