"""Where files and messages come from."""
