"""Sources: file catalogue, layered documents, pixels, metadata tags."""
