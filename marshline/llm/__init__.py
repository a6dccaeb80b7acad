"""Training-data operators: dedup, decontamination, packing, language, PII, chat and token counts."""
