"""featurescape."""
