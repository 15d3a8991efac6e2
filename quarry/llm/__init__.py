"""Training-data operators: quality rules, media columns, packing, near-duplicates,
language identification, licence scans, chat formatting, mixing, language models, WARC."""
