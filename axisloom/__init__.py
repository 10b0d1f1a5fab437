"""axisloom: array, ragged and sparse algebra as DataFrame plans."""
