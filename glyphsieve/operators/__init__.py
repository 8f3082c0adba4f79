"""Operators over tables of files and findings."""
