"""Reading and writing files and tables."""
