"""Reading records and dimensions, writing tables."""
