"""Files and tables: where data comes from and goes to."""
