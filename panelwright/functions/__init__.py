"""Column builders: pointwise, rolling and cross-sectional operators."""
