"""Column expressions: typing, road names, geometry and map projection."""
