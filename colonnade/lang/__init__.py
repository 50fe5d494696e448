"""The statement language: lexer, syntax tree, parser."""
