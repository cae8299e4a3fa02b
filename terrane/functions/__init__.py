"""Column expressions: projection, tile ids, distances, rings, text, colour."""
