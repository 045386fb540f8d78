"""Every operator as a named query over the shared tables, with SQL to check it."""
