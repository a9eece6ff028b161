"""Penalised log-linear heads and the iterative estimators built on them."""
