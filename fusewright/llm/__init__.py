"""Training-data operators: extraction, language, duplicates, decontamination, packing.

Nothing outside this subpackage imports it.
"""
