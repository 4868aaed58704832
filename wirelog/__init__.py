"""Datagram and log-message analytics as Spark DataFrame operators."""
