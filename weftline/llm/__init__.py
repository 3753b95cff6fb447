"""Training-data operators. Nothing else in weftline imports this subpackage."""
