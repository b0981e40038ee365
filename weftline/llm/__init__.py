"""Training-data operators: dedup, decontamination, classifiers, packing, search and extraction.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
