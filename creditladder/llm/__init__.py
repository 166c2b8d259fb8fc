"""Training-data operators: an optional part that nothing else in the library imports."""
