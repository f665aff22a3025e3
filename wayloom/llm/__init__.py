"""Training-data operators (numbered 1-13); nothing outside this subpackage imports it."""
