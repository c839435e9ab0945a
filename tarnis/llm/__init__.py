"""Operators for preparing training text: licence scans, near and exact copies, toxicity, decontamination,
quality rules, pseudonyms, token counts, encoding, and derivatives of web archives."""
