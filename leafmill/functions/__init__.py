"""Column functions: text normalisation, estimates, labels, provider parameters."""
