"""The language: lexer, parser, syntax tree and the features that are known by name."""
