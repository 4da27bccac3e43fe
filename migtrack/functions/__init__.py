"""Column functions (script text, names, reports) and fixed values."""
