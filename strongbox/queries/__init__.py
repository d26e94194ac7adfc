"""Every operator applied to the test tables, with the SQL that states its result."""
