"""DataFrame operators: collections, timing, tiles, surfaces, colour, metadata, jobs."""
