"""Reports, tables and layouts that findings are written to."""
