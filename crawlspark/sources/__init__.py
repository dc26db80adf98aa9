"""Sources of the crawl library."""
