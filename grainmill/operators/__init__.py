"""Part of grainmill: operators."""
