"""Network-log analytics on Spark: scans, profiles, detections, roll-ups, merges and reports as DataFrame jobs."""
