"""Column-level helpers: hash draws, URL splitting and the lexical features."""
