"""Operators over tables of blocks, chunks, formulas, terms and vectors."""
