"""Part of veriglot."""
