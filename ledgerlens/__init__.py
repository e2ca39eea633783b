"""ledgerlens package."""
