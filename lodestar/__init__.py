"""lodestar: a PySpark-native engine for web-contact extraction and crawl-coverage analytics."""
