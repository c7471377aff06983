"""Column functions. None of them holds state or runs Python for each row."""
