"""Operators for large text corpora: filters, near duplicates, decontamination, mixing, packing. Nothing else imports this."""
