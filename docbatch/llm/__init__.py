"""Operations of a training-data pipeline: packing, mixing, dedup, scoring, formats and codecs."""
