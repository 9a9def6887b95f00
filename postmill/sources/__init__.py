"""Where mail comes from: adapters over tables, and containers on a file system."""
