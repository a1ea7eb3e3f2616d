"""Part of grainmill: plans."""
