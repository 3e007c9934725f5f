"""A Spark-native engine for classifying document lines against a tariff hierarchy."""
