"""Source detectors: declarative rules over source texts, compiled to columns."""
