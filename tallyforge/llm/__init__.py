"""Training-data operators: the ten corpus operators and their queries."""
