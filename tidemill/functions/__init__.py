"""Column functions over time, addresses, dynamic values and lists."""
