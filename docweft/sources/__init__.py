"""Where documents come from and where tables go."""
