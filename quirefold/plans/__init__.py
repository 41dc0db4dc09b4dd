"""Registered queries: views of the given tables, operators applied to them, and the SQL each must agree with."""
