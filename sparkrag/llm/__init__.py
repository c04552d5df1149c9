"""Training-data operators: tokenising, exact search, quality and toxicity scoring,
de-duplication, page extraction, media features, chat formatting and packing.

Nothing outside this package imports it.
"""
