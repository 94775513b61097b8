"""From dropped paths to collections, and the registry of named queries."""
