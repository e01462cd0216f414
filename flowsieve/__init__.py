"""Denied-flow analytics on Spark: from flow records to the network policies that would allow them."""
