"""Operators for preparing training text: extraction, deduplication, filtering, decontamination, coding and packing."""
