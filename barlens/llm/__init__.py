"""Training-data operators: ten corpus jobs that nothing else in the package imports."""
