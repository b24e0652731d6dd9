"""Part of matchforge."""
