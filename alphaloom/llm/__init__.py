"""Training-data operators: decontamination, privacy, dedup, quality, extraction, tokens, urls, chat."""
