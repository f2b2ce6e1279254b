"""Table and stream operators for the data side of machine-learning operations."""
