"""The index and its query operators."""
