"""Readers of sequence files, and writers of result bundles."""
