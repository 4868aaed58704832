"""Compositions of operators: the whole decode job and handler chains."""
