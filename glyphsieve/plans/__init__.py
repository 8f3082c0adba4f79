"""Rules, configurations and scan plans."""
