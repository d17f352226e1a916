"""Readers and writers of genotype files."""
