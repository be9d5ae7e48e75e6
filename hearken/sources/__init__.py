"""Readers, landed-page flatteners, generators and writers."""
