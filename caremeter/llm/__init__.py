"""Training-data operators: mixing, token counts, deduplication, packing, language ID, search, chat, WARC."""
