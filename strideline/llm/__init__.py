"""Training-data operators: quality, chat, search, packing, secrets, LM scores, dedup, BPE, language, binary ids."""
