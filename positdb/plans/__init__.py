"""The language: syntax tree, parser and the compiler to DataFrame plans."""
