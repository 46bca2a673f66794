"""Spark operators for catalogues of sampled signals and what is derived from them."""
