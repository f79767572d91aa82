"""Model families, preprocessing stages and search."""
