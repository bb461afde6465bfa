"""Training-data operators: search, decontamination, tokens, licences, classifiers, URLs, WARC, pieces, near-duplicates."""
