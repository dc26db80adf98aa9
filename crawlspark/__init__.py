"""crawlspark: web-corpus and crawl analytics as Spark DataFrame transformations."""
