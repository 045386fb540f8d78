"""Multi-step plans composed from the operators."""
