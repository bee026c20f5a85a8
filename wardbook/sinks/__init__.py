"""Writers: the audit table, landing folders, JSON rows."""
