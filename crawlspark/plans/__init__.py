"""Plans of the crawl library."""
