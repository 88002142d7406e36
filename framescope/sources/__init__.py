"""Reading tables and writing reports."""
