"""Reading tables, and writing audit entries and exports."""
