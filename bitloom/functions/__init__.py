"""Column functions: bits, bytes, epochs, text and human-readable forms."""
