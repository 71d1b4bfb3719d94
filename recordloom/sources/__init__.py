"""Reading tables from files and writing results."""
