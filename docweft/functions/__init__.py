"""Column functions and the rule tables that they apply."""
