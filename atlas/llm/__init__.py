"""Operators of a training-data pipeline: token files, chat text, classifiers, near duplicates, disclosure
control, mixing, exact search, packing. Nothing else in the package imports this one."""
