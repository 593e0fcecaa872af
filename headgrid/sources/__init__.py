"""Reading, writing, importing and publishing of tables."""
