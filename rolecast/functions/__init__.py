"""Column expressions: text, HTML, dates, roles."""
