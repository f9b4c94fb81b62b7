"""Operations that a training-data pipeline needs, each built by one named method."""
