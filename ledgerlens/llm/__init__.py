"""Operators for preparing training text: filters, sharding, archives, chat
formatting, tokenisation, decontamination, language ID and deduplication.

Nothing else in the library imports this package."""
