"""Analytics over streams."""
