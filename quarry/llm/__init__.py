"""Training-data operators: token counts, quality, line dedup, toxicity, exact search,
sharding, near duplicates, decontamination, sampled segmentation and chat formatting.

Nothing else in the library imports this subpackage. ``queries.py`` registers the
``opN_`` queries."""
