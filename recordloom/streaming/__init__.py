"""The part of the flow that runs as jobs finish."""
