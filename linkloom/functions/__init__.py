"""Column builders: text decoding, URL handling, HTML tokens and patterns."""
