"""Reading and writing: files, listings, indexes, sinks."""
