"""Operators for text preparation and entity resolution. Nothing outside this subpackage imports it."""
