"""PySpark operators for transcript, session and inventory analytics on tables and streams."""
