"""Reading libraries, logs and files, and writing tables."""
