"""Every query of the engine over the test tables, with SQL to hold it against."""
