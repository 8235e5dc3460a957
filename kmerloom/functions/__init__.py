"""Scalar functions: parameters, base and k-mer encoding, the mix hash, and the distance formula as columns."""
