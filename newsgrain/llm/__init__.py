"""Corpus operators for language-model training data; nothing outside this subpackage imports them."""
