"""Reading and writing: file listings, array and image files, model tables, sinks."""
