"""Where panels come from and where tables go."""
