"""Relational operators over variants, genotypes and raw records."""
