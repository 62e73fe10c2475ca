"""Extraction of call sites, data access and infrastructure from source text: functions of one file or repository, run over
frames of texts with mapInPandas and applyInPandas."""
