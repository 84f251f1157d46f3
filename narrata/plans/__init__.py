"""Logical plans: the view layers and the analytical questions over them."""
