"""Training-data operators: ten first-class components that nothing else in the library imports."""
