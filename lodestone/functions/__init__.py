"""Column functions over names, labels, citations and keys."""
