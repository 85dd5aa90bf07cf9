"""Readers: SQL, JDBC, files, workbooks, documents, key spaces, API responses, message logs."""
