"""Part of axonlake."""
