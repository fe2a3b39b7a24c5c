"""Training-data operators (deduplication, scanning, tokenising, packing, ...).

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
