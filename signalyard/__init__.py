"""signalyard: quality analytics for sampled signals on Spark."""
