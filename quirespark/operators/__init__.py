"""Part of quirespark; see the README."""
