"""Registered queries and, beside each, the SQL that must give the same rows."""
