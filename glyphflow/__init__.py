"""A PySpark engine for batched crop-text dataflows."""
