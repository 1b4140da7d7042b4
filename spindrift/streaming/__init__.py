"""Change streams: the operators on batches of changes, and their streaming form."""
