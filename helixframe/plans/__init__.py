"""Registered queries: operators applied to tables, and the SQL that checks them."""
