"""Column functions of flow records."""
