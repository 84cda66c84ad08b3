"""Reading uploaded files and tables, writing exports."""
