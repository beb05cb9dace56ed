"""Training-data operators (dedup, scanning, packing, ...). Nothing outside this folder imports it."""
