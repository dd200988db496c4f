"""Plan building: the history projection, shared folders, iteration."""
