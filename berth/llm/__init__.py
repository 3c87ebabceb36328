"""Training-data operators: rules, duplicates, mixing, classifiers, token files."""
