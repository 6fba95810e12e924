"""Operators that prepare training text: repair, deduplication, screening, tokenisation. Nothing else imports this."""
