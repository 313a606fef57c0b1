"""Score files, the catalogue of scores, stored tables and text sinks."""
