"""Jobs over pages, seeds and findings."""
