"""Site-graph analytics on Spark: URLs, links, crawl state, sitemaps."""
