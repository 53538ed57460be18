"""Training-data operators. Nothing else in huestrata imports this subpackage."""
