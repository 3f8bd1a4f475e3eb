"""Chart and algorithm choices as rules over profile rows."""
