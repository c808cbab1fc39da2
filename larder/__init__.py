"""larder: retail catalogue analytics on Spark (search, change queue, replenishment)."""
