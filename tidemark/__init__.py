"""Change tracking on Spark: landed pages, text and tables become typed rows, histories, differences and reports."""
