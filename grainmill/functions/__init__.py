"""Part of grainmill: functions."""
