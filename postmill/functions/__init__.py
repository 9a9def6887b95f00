"""Column functions: names, texts, labels, properties, times, markup."""
