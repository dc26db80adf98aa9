"""Operators of the crawl library."""
