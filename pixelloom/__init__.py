"""pixelloom: pixel-feature analytics expressed as Spark DataFrame plans."""
