"""Whole plans: the channel-network pipeline and the registered queries."""
