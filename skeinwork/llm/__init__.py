"""Training-data operators over document and page tables. Nothing else in the package imports this one."""
