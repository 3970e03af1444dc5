"""tidegauge: drift monitoring and anomaly alerting for event tables and streams on PySpark."""
