"""Part of tidewell; see README."""
