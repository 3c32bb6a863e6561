"""The same diagnoses over streams."""
