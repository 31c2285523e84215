"""Column functions of catalogs, dates and reports."""
