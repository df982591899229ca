"""Operations of a large-scale training-data pipeline, one module each; nothing else in the library imports them."""
