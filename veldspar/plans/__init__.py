"""From definitions to plans: setup checks, the column compiler and apply."""
