"""Column functions: text, names, classes, statistics, geography and page text."""
