"""Image fusion and fusion quality on Spark: images as pixel relations, operators as DataFrame functions."""
