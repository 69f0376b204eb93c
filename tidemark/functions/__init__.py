"""Column expressions: value typing, codec sizes and Bloom bits."""
