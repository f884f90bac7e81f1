"""Sources: driver tables, the retail items view, POS report text lines."""
