"""Part of the tidegauge engine."""
