"""Analytics over hierarchical legal text, expressed as Spark plans."""
