"""Part of grainmill: streaming."""
