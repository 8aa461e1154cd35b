"""Indicator-panel analytics as plain DataFrame transforms."""
