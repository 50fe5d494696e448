"""Types, catalog, constant terms, and the rules that say which queries are legal."""
