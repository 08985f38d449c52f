"""Every query of this package, and the SQL of those that SQL can express."""

from tidewell.llm import chat, decontaminate, html_text, line_dedup, media, ngram_join, packing, quality, sharding, url_filters

MODULES = [url_filters, sharding, decontaminate, quality, packing, line_dedup, media, ngram_join, chat, html_text]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
