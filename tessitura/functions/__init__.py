"""See the package docstring of tessitura."""
