"""Operators for preparing training text: fingerprints, duplicates, mixing, token files, chat, language, packing, crawl records."""
