"""Lexloom: subword tokenization and text preparation as Spark DataFrame transformations."""
