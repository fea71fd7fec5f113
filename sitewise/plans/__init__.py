"""End-to-end analyses composed from the operators."""
