"""Training-data operators over the text tables. Nothing else in the package imports this one."""
