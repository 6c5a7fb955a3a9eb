"""Corpus preparation for training data: classifiers, scans, de-duplication and packing over a ``documents`` table."""
