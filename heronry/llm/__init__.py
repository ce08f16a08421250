"""Corpus preparation operators for training data. Nothing else in heronry imports this subpackage."""
