"""Operations of a training-data pipeline: dedup, filters, mixing, formatting, packing."""
