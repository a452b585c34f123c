"""Readers for files, hash lists, notebooks and notes."""
