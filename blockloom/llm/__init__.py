"""Training-data operators over document, page and label tables.

Nothing else in the library imports this subpackage.
"""
