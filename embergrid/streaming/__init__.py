"""The same transformations over landed files as they arrive."""
