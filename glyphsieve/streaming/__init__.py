"""Scans over streams of files."""
