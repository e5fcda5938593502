"""Analytics over gridded terrain, vector layers and river networks, written as Spark plans."""
