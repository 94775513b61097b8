"""Column functions; none of them starts Python."""
