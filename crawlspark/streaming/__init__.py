"""Streaming of the crawl library."""
