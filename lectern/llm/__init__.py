"""Training-data operators: packing, token counts, quality, near-duplicates, filters, audio, privacy, licences."""
