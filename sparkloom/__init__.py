"""sparkloom: an analytics engine written for PySpark from the ground up."""
