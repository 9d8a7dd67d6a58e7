"""Landed inputs: targets, pages, archives, robots, sitemaps, network logs."""
