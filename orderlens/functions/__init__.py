"""Part of the order-flow engine."""
