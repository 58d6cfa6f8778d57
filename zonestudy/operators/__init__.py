"""Operators on bars, zones, tests of zones and scored events."""
