"""Extension: new keys are embedded as they arrive."""
