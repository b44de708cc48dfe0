"""Operations of a training-data pipeline: dedup, filters, mixing, search, tokens."""
