"""tallymark: order-quality analytics on Spark."""
