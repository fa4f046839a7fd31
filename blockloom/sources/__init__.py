"""Members from files and tables, and back."""
