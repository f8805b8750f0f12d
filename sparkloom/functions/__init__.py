"""Column functions: names, signatures, sets, scores and text measures."""
