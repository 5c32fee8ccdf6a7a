"""Operators over training text: mixing, licences, personal data, decontamination, duplicates, urls, pages, rules, tokens."""
