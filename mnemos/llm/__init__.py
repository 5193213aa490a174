"""Training-data operators: URL filters, quality, packing, BPE, decontamination, toxicity, dedup, counts, licences."""
