"""See README for the modules of this subpackage."""
