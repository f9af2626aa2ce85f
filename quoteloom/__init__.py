"""quoteloom: Spark-native analytics over quote-level price data."""
