"""Layer pipelines: Bronze, Silver and Gold tables from raw files to reports."""
