"""Where cells and codes come from and go to."""
