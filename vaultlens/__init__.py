"""vaultlens: a Spark-native analytics engine for company data rooms."""
