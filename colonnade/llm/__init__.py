"""Operators that prepare training corpora: privacy, licences, duplicates, packing, quality."""
