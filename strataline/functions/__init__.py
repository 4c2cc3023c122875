"""See the package docstring of each module."""
