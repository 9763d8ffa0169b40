"""Column functions: text, money, dates and identifiers of statements."""
