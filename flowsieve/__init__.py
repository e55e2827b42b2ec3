"""flowsieve: network-flow intrusion analytics as Spark DataFrame plans."""
