"""Operators that prepare training text: archives, cleaning, dedup, decontamination, packing."""
