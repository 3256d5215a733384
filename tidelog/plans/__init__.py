"""The registered queries over the virtual log, and the SQL that DuckDB checks them with."""
